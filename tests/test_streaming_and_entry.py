import os

from conftest import SF_SMALL

from docsift.operators import prep as C
from docsift.session import scratch_path
from docsift.sources.fixtures import table
from docsift.streaming import jobs as S


def test_stream_ingest_equals_batch_and_rerun_adds_nothing(spark):
    out, ckpt = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
    S.stream_ingest(spark, SF_SMALL, out, ckpt)
    first = spark.read.parquet(out).select("doc_id", "pos", "n_tokens", "text")
    batch = C.chunk_documents(table(spark, SF_SMALL, "documents"))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, batch.collect()))
    n_dirs = len([d for d in os.listdir(out) if d.startswith("batch=")])
    S.stream_ingest(spark, SF_SMALL, out, ckpt)  # same checkpoint: nothing new
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) == n_dirs


def test_stream_dedupe(spark):
    """Three deliveries of four files, and a restart that finds more."""
    docs = table(spark, SF_SMALL, "documents")
    folder, out, ckpt = (scratch_path(spark, n) for n in ("s2-in", "s2-out", "s2-ckpt"))

    def deliver(df, name):
        df.coalesce(1).write.parquet(f"{folder}/{name}/documents.parquet")

    deliver(docs.filter("doc_id % 2 = 0"), "a")
    deliver(docs.filter("doc_id % 3 = 0"), "b")
    deliver(docs.filter("doc_id % 2 = 0"), "c")

    def stream():
        return (spark.readStream.schema(S.DOC_SCHEMA).option("maxFilesPerTrigger", 1)
                .option("recursiveFileLookup", "true").parquet(folder))

    S.stream_dedupe(stream(), out, ckpt)
    deliver(docs, "d")
    S.stream_dedupe(stream(), out, ckpt)
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() >= 3
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "origin", "source", "score", "text"]
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_queries_equal_batch_search(spark):
    from pyspark.sql import functions as F
    from docsift.operators import lexical as L
    from docsift.plans import registry as R
    idx = R.search_index(spark, SF_SMALL)

    def answer(batch):
        return L.top_k(L.bm25_scores(batch, idx.bm25, term_buckets=idx.term_buckets), 3).select(
            "query_id", "rank", "chunk_id", "score")

    out = S.stream_queries(spark, SF_SMALL, answer)
    got = sorted(map(tuple, spark.read.parquet(out).select("query_id", "rank", "chunk_id", "score").collect()))
    conv = table(spark, SF_SMALL, "conversations").filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    want = sorted(map(tuple, answer(conv).collect()))
    assert got == want and len(got) > 0


def test_registered_plans_have_no_cartesian_and_use_partial_topk(spark):
    import __spark_entry__ as E
    from docsift.operators import hybrid as H
    from docsift.plans import registry as R
    ranked = {"bm25_top5", "knn_exact", "lookup_chunks"}
    for key in ["bm25_top5", "bm25_search", "knn_exact", "semantic_search", "lookup_chunks",
                "chunk_documents", "interleave_summaries", "convert_pages", "bm25_postings"]:
        df = E.queries()[key](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, key
        assert "BatchEvalPython" not in plan, key
        if key in ranked:
            assert "WindowGroupLimit" in plan, key
    # searches rank before their (small) hit table is stored
    idx, q = R.search_index(spark, SF_SMALL), R.bench_queries(spark, SF_SMALL)
    for hits in (H.bm25_hits(q, idx), H.semantic_hits(q, idx)):
        assert "WindowGroupLimit" in hits._jdf.queryExecution().executedPlan().toString()


def test_streams_read_tables_that_are_folders_of_files(spark):
    """Large tables come as folders of part files, in which no file has the table's name."""
    folder = scratch_path(spark, "parts-in")
    table(spark, SF_SMALL, "documents").repartition(3).write.parquet(f"{folder}/documents.parquet")
    table(spark, SF_SMALL, "conversations").repartition(2).write.parquet(f"{folder}/conversations.parquet")
    got = spark.read.parquet(S.stream_ingest(spark, folder)).select("doc_id", "pos", "n_tokens", "text")
    want = C.chunk_documents(table(spark, SF_SMALL, "documents"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    twice = S.document_stream(spark, folder).unionByName(S.document_stream(spark, folder))
    ids = [r.doc_id for r in spark.read.parquet(S.stream_dedupe(twice)).select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in table(spark, SF_SMALL, "documents").select("doc_id").collect())
    answered = spark.read.parquet(S.stream_queries(spark, folder, lambda batch: batch.select("query_id", "text")))
    users = table(spark, SF_SMALL, "conversations").filter("role = 'user'")
    assert answered.count() == users.count() > 0
