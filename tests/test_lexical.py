import math
import string

import pytest
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.operators import lexical as L
from docsift.session import cut_lineage


def tok(text):
    out = []
    for t in text.lower().split():
        t = t.strip(string.punctuation)
        if t and t not in tx.STOP_WORDS:
            out.append(t)
    return out


def py_bm25(passages, query, k1=1.5, b=0.75, eps=0.25):
    """Okapi BM25 as the usual library states it (negative idf -> eps * mean)."""
    docs = [tok(p) for p in passages]
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    scores = [0.0] * n
    for q in tok(query):
        for i, d in enumerate(docs):
            f = d.count(q)
            scores[i] += idf.get(q, 0) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avgdl))
    return scores


CORPORA = [
    (["a fence rule for the city"], "fence city"),
    (["fence one", "fence two", "fence three", "wall"], "fence wall"),
    (["fence height limit", "gate rules", "fence fence gate"], "fence fence gate"),
    (["alpha beta", "gamma delta"], "unknownword"),
    (["same text here", "same text here", "other words"], "same text"),
]


@pytest.mark.parametrize("passages,query", CORPORA)
def test_scores_match_python(spark, passages, query):
    ct = spark.createDataFrame([(i + 1, p) for i, p in enumerate(passages)], "chunk_id long, text string")
    q = spark.createDataFrame([(7, query)], "query_id long, text string")
    idx = L.bm25_index(L.passages(ct))
    got = {r.chunk_id: r.score for r in L.bm25_scores(q, idx).collect()}
    want = py_bm25(passages, query)
    for i, s in enumerate(want):
        if any(t in tok(passages[i]) for t in tok(query)):
            assert got[i + 1] == pytest.approx(s, rel=1e-9, abs=1e-12)
        else:
            assert (i + 1) not in got  # passages without a query word get no score


def test_build_equals_lazy_index(spark):
    passages = ["fence one two", "fence three", "gate", "fence gate gate"]
    ct = spark.createDataFrame([(i + 1, p) for i, p in enumerate(passages)], "chunk_id long, text string")
    psg = L.passages(ct)
    lazy = {(r.term, r.chunk_id): r.w for r in L.bm25_index(psg).collect()}
    built, idf, stats = L.bm25_build(psg, cut_lineage)
    assert stats["n_passages"] == 4
    for r in built.collect():
        assert r.w == pytest.approx(lazy[(r.term, r.chunk_id)], rel=1e-12)


def test_top_k_ties_break_by_id_and_ignore_partitioning(spark):
    passages = ["same text here", "same text here", "same text", "different"]
    ct = spark.createDataFrame([(i + 1, p) for i, p in enumerate(passages)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "same text"), (2, "different")], "query_id long, text string")
    idx = L.bm25_index(L.passages(ct))
    a = sorted(L.top_k(L.bm25_scores(q, idx), 2).collect())
    b = sorted(L.top_k(L.bm25_scores(q, idx.repartition(7, "chunk_id")), 2).collect())
    assert a == b
    q1 = [r.chunk_id for r in sorted(a) if r.query_id == 1]
    # the two identical passages tie; the smaller id ranks first
    ranks = {r.chunk_id: r.rank for r in a if r.query_id == 1}
    assert set(q1) <= {1, 2, 3}
    if 1 in ranks and 2 in ranks:
        assert ranks[1] < ranks[2]
    assert [r.chunk_id for r in a if r.query_id == 2] == [4]


def test_single_passage_corpus(spark):
    ct = spark.createDataFrame([(1, "fence rule")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "fence")], "query_id long, text string")
    out = L.top_k(L.bm25_scores(q, L.bm25_index(L.passages(ct))), 5).collect()
    assert [r.chunk_id for r in out] == [1]


def test_search_plan_has_partial_topk_and_no_python(spark):
    ct = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} fence") for i in range(50)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "fence w1")], "query_id long, text string")
    plan = L.top_k(L.bm25_scores(q, L.bm25_index(L.passages(ct))), 5)._jdf.queryExecution().executedPlan().toString()
    plan_full = L.top_k(L.bm25_scores(q, L.bm25_index(L.passages(ct))), 5)
    plan_full.collect()
    s = plan_full._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "WindowGroupLimit" in s
    assert "CartesianProduct" not in s
    assert "BatchEvalPython" not in s and "ArrowEvalPython" not in s


def test_bucketed_index_prunes_and_keeps_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "POSTINGS_PER_BUCKET", 5)
    monkeypatch.setattr(L, "POSTINGS_PER_FILE", 3)
    passages = [f"fence w{i % 9} gate{i % 4} wall{i % 5}" for i in range(60)]
    ct = spark.createDataFrame([(i + 1, p) for i, p in enumerate(passages)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "fence w3"), (2, "wall2 gate1")], "query_id long, text string")
    index, idf, stats = L.bm25_build(L.passages(ct), cut_lineage)
    assert stats["term_buckets"] > 1
    pruned = L.bm25_scores(q, index, term_buckets=stats["term_buckets"])
    full = L.bm25_scores(q, L.bm25_index(L.passages(ct)))
    a = {(r.query_id, r.chunk_id): r.score for r in pruned.collect()}
    b = {(r.query_id, r.chunk_id): r.score for r in full.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[x] - b[x]) < 1e-9 for x in a)
    assert "PartitionFilters: [isnotnull(tb" in pruned._jdf.queryExecution().executedPlan().toString() \
        or "tb IN" in pruned._jdf.queryExecution().executedPlan().toString() \
        or "tb#" in pruned._jdf.queryExecution().executedPlan().toString()


def test_unique_passages_are_counted_without_a_shuffle(spark):
    """Words were shuffled, and sorted when memory ran short; now passages count their own."""
    from docsift.operators import lexical as L
    rows = [(1, "red red dog"), (2, "dog cat"), (3, None), (4, "the of")]
    psg = spark.createDataFrame(rows, "chunk_id long, text string")
    assert L.unique_ids(psg)
    post = L.bm25_postings(psg, unique=True)
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    want = [(1, "dog", 1, 3), (1, "red", 2, 3), (2, "cat", 1, 2), (2, "dog", 1, 2)]
    assert sorted(map(tuple, post.collect())) == want == sorted(map(tuple, L.bm25_postings(psg).collect()))
    twice = spark.createDataFrame([*rows, (2, "cat cat"), (2, "owl")], "chunk_id long, text string")
    assert not L.unique_ids(twice) and not L.unique_ids(spark.createDataFrame([(None, "a")], "chunk_id long, text string"))
    assert sorted(map(tuple, L.bm25_postings(twice).collect())) == [
        (1, "dog", 1, 3), (1, "red", 2, 3), (2, "cat", 3, 2), (2, "dog", 1, 2), (2, "owl", 1, 1)]


def test_postings_move_once_for_all_queries(spark):
    """Matched postings were shuffled once for each query that has the word."""
    from docsift.operators import lexical as L
    w = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 4.0), ("c", 2, 8.0)], "term string, chunk_id long, w double")
    qt = spark.createDataFrame([(10, "a", 1), (10, "b", 2), (11, "a", 3), (12, "d", 1)], "query_id long, term string, qn long")
    want = [(10, 1, 9.0), (10, 2, 2.0), (11, 1, 3.0), (11, 2, 6.0)]
    few = L.query_chunk_scores(w, qt, True)
    assert "hashpartitioning(query_id" not in few._jdf.queryExecution().executedPlan().toString()
    for scores in (few, L.query_chunk_scores(w, qt, False)):
        assert sorted((r.query_id, r.chunk_id, r.score) for r in scores.collect()) == want


def test_best_scores_are_the_top_of_all_scores(spark, monkeypatch):
    """The kernel of best scores: several slabs, ties, repeated postings, a null query id."""
    import random
    rng = random.Random(3)
    weights = [(f"t{rng.randint(0, 12)}", rng.randint(0, 60) * 7, rng.choice([0.5, 0.25, -0.125, 1.0])) for _ in range(700)]
    index = spark.createDataFrame(weights, "term string, chunk_id long, w double").repartition(3)
    queries = spark.createDataFrame([(i if i != 4 else None, " ".join(f"t{rng.randint(0, 14)}" for _ in range(i))) for i in range(12)],
                                    "query_id long, text string")
    monkeypatch.setattr(L, "SLAB_POSTINGS", 40)
    key = lambda r: (r.query_id is None, r.query_id or 0, r["rank"], r.chunk_id, r.score)
    want = sorted(map(key, L.top_k(L.bm25_scores(queries, index), 3).collect()))
    best = L.bm25_scores(queries, index, best=3)
    assert sorted(map(key, L.top_k(best, 3).collect())) == want and len(want) == 33
    assert "PythonMapInArrow" in best._jdf.queryExecution().toString() or "MapInArrow" in best._jdf.queryExecution().toString()
    assert L.bm25_scores(queries.filter("query_id = 0"), index, best=3).count() == 0
