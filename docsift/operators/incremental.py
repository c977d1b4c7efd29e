"""Incremental processing (D1-D3): which documents still need work, and
the manifest flag kept in step with the outputs. All keyed joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skip_processed(pending: DataFrame, done: DataFrame) -> DataFrame:
    """Pending documents minus those with a non-empty output.
    ``done(doc_id, n_chunks)``."""
    return pending.join(done.filter(F.col("n_chunks") > 0).select("doc_id"), "doc_id", "left_anti")


def mark_chunked(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """After a run, pending documents with a non-empty output are
    flagged; flags already set stay set."""
    d = done.groupBy("doc_id").agg(F.sum("n_chunks").alias("_n"))
    return (manifest.join(d, "doc_id", "left")
            .withColumn("chunked", F.col("chunked") | (F.coalesce(F.col("_n"), F.lit(0)) > 0))
            .drop("_n"))


def reconcile_flags(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """D3: the flag recomputed from the outputs for every row, both ways."""
    d = done.groupBy("doc_id").agg(F.sum("n_chunks").alias("_n"))
    return (manifest.join(d, "doc_id", "left")
            .withColumn("chunked", F.coalesce(F.col("_n"), F.lit(0)) > 0).drop("_n"))
