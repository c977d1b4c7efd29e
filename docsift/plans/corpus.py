"""The corpus plan: documents -> chunk table.

chunk table: (chunk_id, document_id, pos, kind, text)
  kind 'chunk'   - a merged chunk of at most 256 words
  kind 'summary' - the summary of the five chunks right before it
  pos            - 1-based position in the document once summaries are
                   interleaved; chunk_id = documents-before offset + pos.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.functions.arrays import explode_rows, posexplode_rows
from docsift.functions import text as tx
from docsift.operators import prep
from docsift.operators.broadcast import broadcast_if_small
from docsift.operators.ids import running_offsets
from docsift.operators.summarize import extractive_summary

MAX_BROADCAST_OFFSETS = 4_000_000

Summarizer = Callable[[DataFrame, list, str], DataFrame]


def default_summarizer(groups: DataFrame, keys: list, text_col: str) -> DataFrame:
    return extractive_summary(groups, keys, text_col)


def chunk_table(docs: DataFrame, summarizer: Summarizer | None = None,
                max_tokens: int = tx.MAX_TOKENS, group: int = tx.CHUNKS_PER_SUMMARY,
                materialize=None) -> DataFrame:
    """``materialize`` (default: Parquet under the checkpoint folder) stores
    the per-document chunk arrays once; counts, chunk rows and groups are
    then read from it instead of re-chunking the documents three times."""
    from docsift.session import cut_lineage
    summarizer = summarizer or default_summarizer
    materialize = materialize or (lambda d: cut_lineage(d, "chunk-arrays"))
    # n_chunks is stored beside the arrays: the offsets read two narrow
    # columns, not the chunk text
    arr = materialize(prep.chunk_arrays(docs, max_tokens).withColumn("n_chunks", F.size("chunks")))
    n = F.col("n_chunks")
    slots = arr.select("doc_id", (n + F.floor(n / group)).cast("bigint").alias("slots"))
    off = running_offsets(slots, "doc_id", "slots")
    # two numbers a document: broadcast up to 64 MB, so that texts stay where they are
    placed = arr.join(broadcast_if_small(off.select("doc_id", "offset"), MAX_BROADCAST_OFFSETS), "doc_id")

    chunks = (placed.select("doc_id", "offset", F.posexplode("chunks").alias("i", "c"))
              .select(F.col("doc_id").alias("document_id"), "offset",
                      prep.interleaved_local_ids(F.col("i") + 1, group).alias("pos"),
                      F.lit("chunk").alias("kind"), F.col("c.text").alias("text")))

    group_arr = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("chunks") / group).cast("int") - 1),
        lambda g: F.struct(g.alias("g"), F.array_join(F.transform(
            F.slice("chunks", g * group + 1, group), lambda c: c["text"]), "").alias("text")))
    groups = (explode_rows(placed.filter(F.col("n_chunks") >= group), ["doc_id", "offset"], group_arr, "x")
              .select("doc_id", "offset", F.col("x.g").alias("grp"), F.col("x.text").alias("text")))
    summaries = (summarizer(groups, ["doc_id", "grp", "offset"], "text")
                 .select(F.col("doc_id").alias("document_id"), "offset",
                         prep.summary_local_id(F.col("grp"), group).alias("pos"),
                         F.lit("summary").alias("kind"), F.col("summary").alias("text")))
    summaries = materialize(summaries)  # the table is read more than once

    return (chunks.unionByName(summaries)
            .select((F.col("offset") + F.col("pos")).cast("bigint").alias("chunk_id"),
                    F.col("document_id").cast("bigint").alias("document_id"),
                    F.col("pos").cast("int").alias("pos"), "kind", "text"))


def document_sources(docs: DataFrame) -> DataFrame:
    """(document_id, source): the manifest name of every document."""
    from docsift.sources.fixtures import document_name
    return docs.select(F.col("doc_id").alias("document_id"), document_name(docs).alias("source"))
