"""Lookups (B2-B6) as set-at-a-time joins instead of one query per hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def lookup_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """B2: (text, document_id) for every hit's chunk_id (unique key)."""
    return hits.join(chunks.select("chunk_id", "text", "document_id"), "chunk_id")


def lookup_document_name(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Document id -> filename (left join: unknown ids keep a NULL)."""
    return hits.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")


def pending_documents(manifest: DataFrame) -> DataFrame:
    """Names of documents not chunked yet."""
    return manifest.filter(~F.coalesce(F.col("chunked"), F.lit(False))).select("document_name")


def document_splits(names: DataFrame, manifest: DataFrame) -> DataFrame:
    """The split list of each named document (exact name), one row per
    split path."""
    m = manifest.select("document_name", "document_splits")
    return (names.select("document_name").join(m, "document_name")
            .select("document_name", F.posexplode(F.split("document_splits", ",")).alias("i", "p"))
            .select("document_name", (F.col("i") + 1).alias("split_no"), F.ltrim("p").alias("split_path")))


def name_contains(names: DataFrame, needles: DataFrame) -> DataFrame:
    """Every (needle, document_name) where the name contains the needle
    literally (no LIKE wildcards). Names and needles meet on one gram (up to
    three characters) of the needle, the one that fewest names have; the
    containment is then verified. No size switch, no cartesian product; the
    empty needle is in every name."""
    n = names.select("document_name").filter(F.col("document_name").isNotNull())
    nd = needles.select("needle").filter(F.col("needle").isNotNull())

    def grams(text, size):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1),
                                            lambda i: F.substring(text, i, size)))

    sizes = nd.filter("needle <> ''").select(F.least(F.length("needle"), F.lit(GRAM)).alias("size")).distinct()
    of_names = (n.join(F.broadcast(sizes), F.length("document_name") >= F.col("size"))  # at most GRAM sizes
                .select("document_name", F.explode(grams(F.col("document_name"), F.col("size"))).alias("g")))
    common = of_names.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rarest = (nd.filter("needle <> ''").distinct()
              .select("needle", F.explode(grams(F.col("needle"), F.least(F.length("needle"), F.lit(GRAM)))).alias("g"))
              .join(common, "g", "left")
              .groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r"))
              .select("needle", F.col("r.g").alias("g")))
    hits = (of_names.join(rarest, "g").filter(F.instr(F.col("document_name"), F.col("needle")) > 0)
            .select("document_name", "needle"))
    empty = nd.filter("needle = ''").limit(1)
    return hits.unionByName(n.join(F.broadcast(empty), F.lit(True)).select("document_name", "needle"))
