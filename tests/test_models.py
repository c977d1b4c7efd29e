"""Model-shaped callables plug in through the Arrow-batched wrappers."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from docsift.functions import models as M
from docsift.operators import hybrid as H


def test_pluggable_models_in_hybrid_search(spark):
    # factories are defined here so they are shipped to the workers by value
    def make_embedder():
        def encode(texts):  # a stand-in model: bag of crc32-hashed words, 16 dims
            out = np.zeros((len(texts), 16), dtype=np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, zlib.crc32(w.encode()) % 16] += 1.0
                n = np.linalg.norm(out[i])
                if n:
                    out[i] /= n
            return out
        return encode


    def make_reranker():
        def score(queries, texts):
            return [len(set(q.lower().split()) & set(t.lower().split())) for q, t in zip(queries, texts)]
        return score


    def make_summarizer():
        def summarize(texts):  # answers the way a chat model does: quoted, with a lead-in
            return [f'Sure: "{t[:40]}" hope this helps' for t in texts]
        return summarize

    passages = ["fence height rules", "gate permits", "pool safety barrier", "fence paint colours",
                "garden wall limits", "noise rules", "parking permits", "tree removal"]
    ct = spark.createDataFrame([(i + 1, i + 1, 1, "chunk", p) for i, p in enumerate(passages)],
                               "chunk_id long, document_id long, pos int, kind string, text string")
    src = spark.createDataFrame([(i + 1, f"/d/doc_{i + 1}.pdf") for i in range(len(passages))],
                                "document_id long, source string")
    emb = M.embed_model_udf(make_embedder)
    idx = H.SearchIndex.build(ct, src, embedder=emb)
    q = spark.createDataFrame([(1, "fence rules"), (2, "permits for parking")], "query_id long, text string")
    out = H.hybrid_search(q, idx, query_embedder=emb, reranker=M.rerank_model_udf(make_reranker),
                          summarizer=M.model_summarizer(M.text_model_udf(make_summarizer), "Sure:"))
    rows = out.collect()
    top1 = [r for r in rows if r.query_id == 1 and r.rank == 1][0]
    assert top1.text == "fence height rules"  # shares two words with the query
    summ = [r for r in rows if r.query_id == 1 and r.rank == 0][0]
    assert summ.origin == "summary" and not summ.text.startswith("Sure")  # E3 took the quoted span
    assert sorted(r.rank for r in rows if r.query_id == 2) == list(range(0, 7))


def test_model_rewrite_cleans_output(spark):
    def make_rewriter():
        return lambda texts: [f'Here you go: "{t.upper()}"' for t in texts]
    udf = M.text_model_udf(make_rewriter)
    q = spark.createDataFrame([(1, "fence rules")], "query_id long, text string")
    got = q.select(M.clean_model_output(udf(F.col("text"))).alias("t")).first().t
    assert got == "FENCE RULES"


def test_a_failing_model_call_is_repeated(spark):
    def make_model():
        state = {"calls": 0}

        def call(texts):
            state["calls"] += 1
            if state["calls"] % 2:
                raise RuntimeError("busy")
            return [t + "!" for t in texts]
        return call

    q = spark.createDataFrame([(1, "fence rules")], "query_id long, text string")
    rewrite = M.model_rewriter(M.text_model_udf(make_model, wait_s=0.0))
    assert rewrite(q).first().text == "fence rules!"


def test_reranked_texts_are_cut_to_the_model_length(spark):
    udf = M.rerank_model_udf(lambda: lambda qs, ts: [float(len(t.split())) for t in ts], max_words=3)
    df = spark.createDataFrame([("q", "one two three four five"), ("q", None)], "q string, t string")
    assert [r.s for r in df.select(udf("q", "t").alias("s")).collect()] == [3.0, 0.0]
