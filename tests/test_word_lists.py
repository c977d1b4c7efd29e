"""The search index from passages' word lists."""
import numpy as np
from pyspark.sql import functions as F

from docsift.operators import lexical as L
from docsift.operators import vectors as V
from docsift.operators import word_lists as W
from docsift.operators.hybrid import SearchIndex
from docsift.operators.summarize import extractive_summary
from docsift.session import cut_lineage


def table(spark, shift=0):
    texts = [f"fence w{i % 9} gate{i % 4} only{i} ünï{i % 3} gate{i % 4}" for i in range(60)] + [None, "", "the of"]
    return spark.createDataFrame([(i + 1 + shift, t) for i, t in enumerate(texts)], "chunk_id long, text string")


def index_rows(index):
    return sorted((r.term, r.chunk_id, r.tf, r.df, round(r.w, 9)) for r in index.collect())


def test_index_is_inverted_without_a_join_by_word(spark, monkeypatch):
    """Postings met their df by a join on the word once words were more than a broadcast took."""
    monkeypatch.setattr(L, "MAX_BROADCAST_TERMS", 3)
    monkeypatch.setattr(L, "POSTINGS_PER_BUCKET", 50)
    monkeypatch.setattr(L, "POSTINGS_PER_FILE", 20)
    for shift in (0, 1 << 40):
        psg = table(spark, shift).repartition(3)
        want = index_rows(L.bm25_index(psg))
        built, _, stats = L.bm25_build(psg, cut_lineage)
        assert stats["known"] is not None and index_rows(built) == want
        plan = W.inverted(stats["lists"], stats["known"], 0, 1, 1)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        monkeypatch.setattr(W, "MAX_KNOWN_WORDS", 3)  # more known words than are broadcast
        built, _, stats = L.bm25_build(psg, cut_lineage)
        assert stats["known"] is None and index_rows(built) == want
        monkeypatch.undo()
        monkeypatch.setattr(L, "MAX_BROADCAST_TERMS", 3)


def test_ids_far_apart_keep_their_width(spark):
    psg = spark.createDataFrame([(-(1 << 62), "red dog"), (5, "red"), (1 << 61, "dog owl")], "chunk_id long, text string")
    built, _, stats = L.bm25_build(psg, cut_lineage)
    assert stats["known"] is not None and index_rows(built) == index_rows(L.bm25_index(psg))


def test_vectors_of_word_lists_are_those_of_the_postings(spark):
    psg = table(spark)
    _, idf, stats = L.bm25_build(psg, cut_lineage)
    n = float(stats["n_passages"])
    new = {r.chunk_id: np.array(r.vec) for r in W.embed_lists(stats["lists"], stats["known"], n, 256).collect()}
    old = {r.chunk_id: np.array(r.vec) for r in V.embed_corpus(stats["postings"], F.lit(n), terms=idf.select("term", "df")).collect()}
    assert len(new) == 63 and all(np.allclose(new[i], v, atol=1e-6) for i, v in old.items())
    assert all(not new[i].any() for i in set(new) - set(old))


def test_build_embeds_every_chunk_once(spark):
    ct = table(spark).select("chunk_id", F.col("chunk_id").alias("document_id"), F.lit(1).alias("pos"), F.lit("chunk").alias("kind"), "text")
    idx = SearchIndex.build(ct, ct.select("document_id", F.lit("a").alias("source")))
    assert sorted(r.id for r in idx.vectors.select("id").collect()) == list(range(1, 64))


def test_summary_counts_words_in_the_group(spark):
    """Groups of several texts, of one key twice, without words and of a null key."""
    rows = [(1, "red dog. owl! red red? dog owl owl. the of. ..."), (2, None), (2, ""), (3, "cat. cat. Cat dog"), (3, "dog. bee"), (None, "cat")]
    df = spark.createDataFrame(rows, "k long, text string")
    got = sorted(((r.k or 0, r.summary) for r in extractive_summary(df, ["k"], n_sent=2).collect()))
    assert got == [(0, ""), (1, "owl. red red."), (2, ""), (2, ""), (3, "dog. Cat dog."), (3, "dog. Cat dog.")]
