"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. Stages are timed separately: the offline build
(chunk table, BM25 index, vectors) and each online query over the whole
benchmark query table, plus k-NN quality (recall@10 and candidate share of
the approximate searches against the exact one). Before timing, the same
pipeline runs once on the smallest tables (untimed) so that JVM start-up,
code generation and Python worker start are not charged to the first stage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from docsift.operators import hybrid as H  # noqa: E402
from docsift.operators import lexical as L  # noqa: E402
from docsift.operators import quantized as PQ  # noqa: E402
from docsift.operators import vectors as V  # noqa: E402
from docsift.plans import corpus, registry  # noqa: E402
from docsift.session import cut_lineage, get_session, scratch_path  # noqa: E402
from docsift.sources.fixtures import table  # noqa: E402


def timed(fn):
    t = time.time()
    out = fn()
    return out, round(time.time() - t, 3)


def run_all(df) -> None:
    """Evaluate every column of every row without sending any to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(cpus, shuffle_partitions=int(cpus) * 2, app="docsift-bench")
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        wd = table(spark, warm, "documents")
        widx = H.SearchIndex.build(corpus.chunk_table(wd), corpus.document_sources(wd))
        run_all(H.hybrid_search(registry.bench_queries(spark, warm), widx))

    q = {}
    docs = table(spark, sf, "documents")
    queries = registry.bench_queries(spark, sf)

    ct, q["build_chunk_table"] = timed(lambda: cut_lineage(corpus.chunk_table(docs), "chunks"))
    n_chunks = ct.count()
    idx, q["build_index"] = timed(lambda: H.SearchIndex.build(ct, corpus.document_sources(docs),
                                                              materialize=cut_lineage))
    n_lists = max(1, int(round(n_chunks ** 0.5)))
    ivf_idx, q["build_ivf_chunks"] = timed(lambda: V.ivf_build(idx.vectors, scratch_path(spark, "ivf"), n_lists))
    _, q["bm25_search"] = timed(lambda: run_all(H.bm25_search(queries, idx)))
    sem_exact, q["semantic_search"] = timed(lambda: cut_lineage(H.semantic_search(queries, idx)))
    idx.ivf = ivf_idx
    sem_ivf, q["semantic_search_ivf"] = timed(lambda: cut_lineage(
        H.semantic_search(queries, idx, method="ivf", nprobe=max(1, n_lists // 10))))
    _, q["hybrid_search"] = timed(lambda: run_all(H.hybrid_search(queries, idx)))
    _, q["bm25_scores_all"] = timed(lambda: run_all(L.bm25_scores(queries, idx.bm25, term_buckets=idx.term_buckets)))

    e = cut_lineage(V.vectors_from_table(table(spark, sf, "embeddings")), "emb")
    eq = e.select(F.col("id").alias("query_id"), "vec")
    n_vec = e.count()
    exact, q["knn_exact"] = timed(lambda: cut_lineage(V.knn_exact(eq, e, k=10, exclude_self=True), "exact"))
    nlist = max(1, min(100, n_vec // 20))

    def ivf():
        cent, _ = V.ivf_train(e, nlist=nlist)
        assigned = cut_lineage(V.ivf_assign(e, cent), "ivf")
        return cut_lineage(V.ivf_search(eq, assigned, cent, k=10, nprobe=max(1, nlist // 2),
                                        exclude_self=True), "ivfres")
    ivf_res, q["ivf_search"] = timed(ivf)

    def lsh():
        res, stats = V.lsh_search(eq, e, k=10, exclude_self=True)
        return cut_lineage(res, "lsh"), cut_lineage(stats, "lshstats")
    (lsh_res, lsh_stats), q["ann_search"] = timed(lsh)

    pq, q["pq_build"] = timed(lambda: PQ.build(e, scratch_path(spark, "pq")))
    pq_res, q["pq_search"] = timed(lambda: cut_lineage(PQ.search(eq, pq, k=10, exclude_self=True), "pqres"))

    def recall(res):
        r = V.ann_recall(res, exact, lsh_stats, n_vec, 10)
        return r.agg(F.avg("recall")).first()[0]

    sem_hit = (sem_exact.select("query_id", "chunk_id")
               .join(sem_ivf.select("query_id", "chunk_id", F.lit(1).alias("h")), ["query_id", "chunk_id"], "left")
               .agg(F.avg(F.coalesce("h", F.lit(0)))).first()[0])
    quality = {"semantic_ivf_recall_at_10": round(sem_hit, 4), "semantic_ivf_lists": n_lists,
               "semantic_ivf_nprobe": max(1, n_lists // 10),"lsh_recall_at_10": round(recall(lsh_res), 4),
               "lsh_candidate_share": round(lsh_stats.agg(F.avg("evaluated")).first()[0] / n_vec, 4),
               "ivf_recall_at_10": round(recall(ivf_res), 4),
               "pq_recall_at_10": round(recall(pq_res), 4),
               "pq_measured_share": round(PQ.measured(eq, pq).agg(F.avg("evaluated")).first()[0] / n_vec, 4),
               "ivf_nlist": nlist}

    from docsift.streaming import jobs as S
    _, q["stream_ingest"] = timed(lambda: S.stream_ingest(spark, sf))

    total = round(sum(q.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": q,
        "sf": os.path.basename(sf.rstrip("/")),
        "chunks": n_chunks,
        "chunks_per_sec": round(n_chunks / max(q["build_chunk_table"], 1e-9), 1),
        "n_queries": queries.count(), "quality": quality,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
