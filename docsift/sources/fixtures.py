"""Loading the given tables and deriving the reference's input shapes
(manifest, document names) from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def document_name(doc: DataFrame) -> "F.Column":
    """Path of the source file a document row stands for."""
    return F.concat(F.lit("/data/"), doc["source"], F.lit("/doc_"),
                    doc["doc_id"].cast("string"), F.lit(".pdf"))


def page_count(text_col) -> "F.Column":
    """A 'page' of a fixture document is one line of its text."""
    return F.size(F.split(text_col, "\n"))


def manifest_seed(docs: DataFrame) -> DataFrame:
    """(doc_id, document_name, n_pages, chunked): the state of the manifest
    fixture. A third of the documents (doc_id % 3 = 0) count as chunked."""
    return docs.select(
        "doc_id",
        document_name(docs).alias("document_name"),
        F.when(docs["text"].isNull(), F.lit(0)).otherwise(page_count(docs["text"])).alias("n_pages"),
        ((docs["doc_id"] % 3) == 0).alias("chunked"),
    )


def comma_names(docs: DataFrame) -> DataFrame:
    """Document paths with ', draft' before '.pdf' where doc_id % 7 = 0."""
    name = F.concat(
        F.lit("/data/"), docs["source"], F.lit("/doc_"), docs["doc_id"].cast("string"),
        F.when((docs["doc_id"] % 7) == 0, F.lit(", draft")).otherwise(F.lit("")),
        F.lit(".pdf"))
    return docs.select("doc_id", name.alias("path"))


def done_outputs(chunk_counts: DataFrame) -> DataFrame:
    """The fixture's earlier-run state: outputs exist for doc_id % 3 = 0, and
    are empty (a failed run) for doc_id % 9 = 0. (doc_id, n_chunks)."""
    return (chunk_counts.filter((F.col("doc_id") % 3) == 0)
            .select("doc_id", F.when((F.col("doc_id") % 9) == 0, F.lit(0).cast("bigint"))
                    .otherwise(F.col("n_chunks").cast("bigint")).alias("n_chunks")))
