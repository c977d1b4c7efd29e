"""Structured Streaming jobs.

* S1 ingest: new document files are picked up by the file source (its
  checkpoint remembers what was read), chunked in ``foreachBatch`` and
  written to ``batch=<id>`` with overwrite, so a replayed batch rewrites
  the same directory instead of duplicating rows.
* S2 dedupe: a re-delivered document is dropped by an anti join with the
  ids written before, so nothing repeats however late it comes again.
* S3 queries: a stream of queries answered against a static index.
  Ranking windows are not allowed on a stream, so ranking runs per
  micro-batch inside ``foreachBatch``.

Every run uses ``trigger(availableNow=True)`` and waits for its end.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.operators import prep
from docsift.session import scratch_path

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CONV_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return _stream(spark, folder, "documents", DOC_SCHEMA, files_per_trigger)


def _stream(spark: SparkSession, folder: str, name: str, schema: str, files_per_trigger: int) -> DataFrame:
    """The files of a table as they arrive: ``<name>.parquet`` is one file, or a
    folder of part files. The path is a pattern ([t]), so that it may still be absent."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{folder}/{name}.parque[t]"))


def _run(df: DataFrame, fn: Callable[[DataFrame, int], None], ckpt: str) -> None:
    q = (df.writeStream.foreachBatch(fn).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_ingest(spark: SparkSession, folder: str, out: str | None = None, ckpt: str | None = None,
                  files_per_trigger: int = 1) -> str:
    """Chunk every document file that arrives in ``folder``; returns the
    output path (rows: doc_id, pos, n_tokens, text, batch)."""
    out = out or scratch_path(spark, "ingest-out")
    ckpt = ckpt or scratch_path(spark, "ingest-ckpt")

    def batch(df: DataFrame, epoch: int) -> None:
        (prep.chunk_documents(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}"))

    _run(_stream(spark, folder, "documents", DOC_SCHEMA, files_per_trigger), batch, ckpt)
    return out


def stream_dedupe(stream: DataFrame, out: str | None = None, ckpt: str | None = None) -> str:
    """Each document of a stream with re-deliveries is processed once,
    however late it comes again: a batch keeps one row of each id and leaves
    out the ids that other batches have written. A replayed batch rewrites
    its own folder."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, "dedupe-out")
    ckpt = ckpt or scratch_path(spark, "dedupe-ckpt")

    def batch(df: DataFrame, epoch: int) -> None:
        fresh = df.dropDuplicates(["doc_id"])
        try:
            done = df.sparkSession.read.parquet(out).filter(F.col("batch") != epoch).select("doc_id")
            fresh = fresh.join(done, "doc_id", "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _run(stream, batch, ckpt)
    return out


def stream_queries(spark: SparkSession, folder: str, answer: Callable[[DataFrame], DataFrame],
                   out: str | None = None, ckpt: str | None = None) -> str:
    """S3: user turns of ``conversations`` arrive as queries
    (query_id = conv_id * 1000 + turn); ``answer`` ranks one micro-batch."""
    out = out or scratch_path(spark, "queries-out")
    ckpt = ckpt or scratch_path(spark, "queries-ckpt")
    qs = (_stream(spark, folder, "conversations", CONV_SCHEMA, 1)
          .filter(F.col("role") == "user")
          .select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text"))

    def batch(df: DataFrame, epoch: int) -> None:
        answer(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    _run(qs, batch, ckpt)
    return out
