from pyspark.sql import functions as F

import pandas as pd

from docsift.operators import hybrid as H


def _index(spark, passages):
    ct = spark.createDataFrame([(i + 1, i + 1, 1, "chunk", p) for i, p in enumerate(passages)],
                               "chunk_id long, document_id long, pos int, kind string, text string")
    src = spark.createDataFrame([(i + 1, f"/data/s/doc_{i + 1}.pdf") for i in range(len(passages))],
                                "document_id long, source string")
    return H.SearchIndex.build(ct, src)


PASSAGES = ["fence height rules for the city", "gate and fence permits", "pool safety barrier",
            "garden wall limits", "fence height rules for the city", "noise rules at night",
            "parking permits downtown", "tree removal permits", "fence paint colours", "solar panels",
            "roof repairs", "driveway width", "mailbox placement", "street lights"]


def test_hybrid_batch_queries_do_not_mix(spark):
    idx = _index(spark, PASSAGES)
    q = spark.createDataFrame([(1, "fence height"), (2, "zzzz unknown")], "query_id long, text string")
    out = H.hybrid_search(q, idx)
    r1 = out.filter("query_id = 1").collect()
    r2 = out.filter("query_id = 2").collect()
    # query 1: six re-ranked rows plus one summary row, ranks 0..6
    assert sorted(r.rank for r in r1) == list(range(0, 7))
    assert [r.origin for r in r1 if r.rank == 0] == ["summary"]
    # identical texts collapse: the duplicated passage appears once
    texts = [r.text for r in r1 if r.rank > 0]
    assert len(texts) == len(set(texts))
    # query 2 has no lexical hit but still gets semantic candidates
    assert all(r.origin in ("semantic", "summary") for r in r2)
    assert len([r for r in r2 if r.rank > 0]) == 6


def test_dedupe_keeps_last_position(spark):
    rows = [(1, 1, 10, "semantic", 0.1, "s", "same"), (1, 1, 11, "lexical", 2.0, "s", "same"),
            (1, 2, 12, "semantic", 0.2, "s", "other")]
    lists = spark.createDataFrame(rows, "query_id long, rank int, chunk_id long, origin string, "
                                        "score double, source string, text string")
    out = H.dedupe_candidates(H.hybrid_concat(lists)).collect()
    same = [r for r in out if r.text == "same"]
    assert len(same) == 1 and same[0].origin == "lexical" and same[0].pos == 11


def test_rerank_scores_are_coverage(spark):
    idx = _index(spark, PASSAGES)
    q = spark.createDataFrame([(1, "fence height")], "query_id long, text string")
    cands = spark.createDataFrame([(1, 1, 1, "fence height rules"), (1, 2, 2, "nothing relevant"),
                                   (1, 3, 3, "fence only")],
                                  "query_id long, pos int, chunk_id long, text string")
    got = {r.pos: r.score for r in H.rerank_scores(cands, q, idx.idf).collect()}
    assert got[1] == 1.0 and got[2] == 0.0 and 0 < got[3] < 1


def test_reads_from_one_and_many_blocks_agree(spark, monkeypatch):
    idx = _index(spark, PASSAGES)
    q = spark.createDataFrame([(1, "fence height"), (2, "permits")], "query_id long, text string")
    plain = sorted(tuple(r) for r in H.hybrid_search(q, idx).collect())
    monkeypatch.setattr(H, "CHUNK_BLOCK_SHIFT", 2)  # several blocks for 14 chunks
    idx2 = _index(spark, PASSAGES)
    assert idx2.chunk_blocks.select("cb").distinct().count() > 1
    assert sorted(tuple(r) for r in H.hybrid_search(q, idx2).collect()) == plain


def test_a_rewriter_and_an_embedder_run_once(spark):
    """A rewriter that answers differently each time: what is embedded is
    what the word slice was cut for, and each query is rewritten once."""
    import random
    from pyspark.sql import functions as F
    calls = spark.sparkContext.accumulator(0)
    words = "fence height gate permits pool safety noise rules".split()

    @F.pandas_udf("string")
    def sampled(s: "pd.Series") -> "pd.Series":
        calls.add(len(s))
        return s.map(lambda _: " ".join(random.sample(words, 2)))

    idx = _index(spark, PASSAGES)
    q = spark.createDataFrame([(1, "fence height"), (2, "permits")], "query_id long, text string")
    out = H.hybrid_search(q, idx, rewrite=lambda d: d.withColumn("text", sampled("text")), with_summary=False).collect()
    assert calls.value == 2
    assert {r.query_id for r in out} == {1, 2}


def test_a_saved_index_answers_as_the_built_one(spark):
    from docsift.session import scratch_path
    idx = _index(spark, PASSAGES)
    path = scratch_path(spark, "saved")
    assert H.SearchIndex.load(spark, path) is None
    idx.save(path)
    q = spark.createDataFrame([(1, "fence height"), (2, "permits")], "query_id long, text string")
    got = sorted(tuple(r) for r in H.hybrid_search(q, H.SearchIndex.load(spark, path)).collect())
    assert got == sorted(tuple(r) for r in H.hybrid_search(q, idx).collect())


def test_a_stale_index_is_refused(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 1, 1, "chunk", "alpha beta"), (2, 1, 2, "chunk", "gamma")],
                                   "chunk_id long, document_id long, pos int, kind string, text string")
    sources = spark.createDataFrame([(1, "a.pdf")], "document_id long, source string")
    path = str(tmp_path / "index")
    H.SearchIndex.build(chunks, sources).save(path)
    assert H.SearchIndex.load(spark, path, chunks) is not None
    edited = chunks.withColumn("text", F.when(F.col("chunk_id") == 2, "gamma!").otherwise(F.col("text")))
    for other in (edited, chunks.filter("chunk_id = 1"), chunks.union(edited.filter("chunk_id = 2"))):
        assert H.SearchIndex.load(spark, path, other) is None
