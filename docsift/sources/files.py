"""File sources and sinks (A1-A5).

Listing uses the ``binaryFile`` source with only ``path`` and ``length``
selected, so file contents are never read. Chunk lines are JSON, one row
per chunk, written with ``document_id`` in every row and partitioned by
``kind``; no file or directory per document (that would explode the file
count at scale).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_GLOB = "*.{[pP][dD][fF],[jJ][sS][oO][nN]}"
SOURCE_SUFFIX = r"(?i)\.(pdf|json)$"

CHUNK_LINE = T.StructType([
    T.StructField("document_id", T.LongType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
SUMMARY_LINE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("id", T.LongType()),
    T.StructField("embedding", T.LongType()),
])


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """A1: every .pdf / .json file below ``root`` (any case): (path, length)."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", SOURCE_GLOB)
            .load(root)
            .select("path", "length"))


def source_paths(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """A1 over a listing that is already a table: keep .pdf/.json paths."""
    return listing.filter(F.col(path_col).rlike(SOURCE_SUFFIX))


def clean_file_names(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """A2: commas removed from the basename only; reports old and new path,
    whether it changes, and how many paths end up with the same new name
    (a collision the plain rename would overwrite silently)."""
    d = F.regexp_extract(F.col(path_col), r"^(.*/)?[^/]*$", 1)
    base = F.substring_index(F.col(path_col), "/", -1)
    new = F.concat(d, F.replace(base, F.lit(","), F.lit("")))
    out = paths.select(F.col(path_col).alias("old_path"), new.alias("new_path"))
    # collision counts by a partial aggregate joined back (a name shared by a
    # third of all files is pre-counted in every task, not gathered in one)
    same = out.groupBy("new_path").agg(F.count(F.lit(1)).alias("n_same_name"))
    return (out.join(same, "new_path")
            .select("old_path", "new_path", (F.col("old_path") != F.col("new_path")).alias("renamed"),
                    "n_same_name"))


def write_chunk_lines(chunks: DataFrame, path: str, n_files: int | None = None) -> None:
    """A4: one JSON line per chunk; rows carry document_id, files are sized
    by the writer, not one per document."""
    rows = chunks.select(F.col("document_id").cast("bigint"), F.col("chunk_id").cast("bigint"), "text")
    if n_files:
        rows = rows.repartition(n_files, "document_id")
    rows.write.mode("overwrite").json(f"{path}/kind=chunk")


def append_summary_lines(summaries: DataFrame, path: str, batch: int = 0) -> None:
    """A5: summary rows appended beside the chunk rows under kind=summary,
    so a re-read never mistakes a summary for a chunk. Each ``batch`` has
    its own folder, so running it again replaces its rows."""
    (summaries.select("text", F.col("document_id").cast("bigint"), F.col("chunk_id").cast("bigint").alias("id"),
                      F.col("chunk_id").cast("bigint").alias("embedding"))
     .write.mode("overwrite").json(f"{path}/kind=summary/batch={batch}"))


def read_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """A3: both line shapes read with declared schemas (never inferred);
    malformed lines land in ``_bad`` instead of failing the job.
    (document_id, chunk_id, kind, text, _bad, file)."""
    schema = T.StructType(CHUNK_LINE.fields + [T.StructField("_bad", T.StringType())])
    chunks = (spark.read.schema(schema).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", "_bad").json(f"{path}/kind=chunk")
              .select("document_id", "chunk_id", F.lit("chunk").alias("kind"), "text", "_bad",
                      F.col("_metadata.file_path").alias("file")))
    sschema = T.StructType(SUMMARY_LINE.fields + [T.StructField("_bad", T.StringType())])
    try:
        summ = (spark.read.schema(sschema).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_bad").json(f"{path}/kind=summary")
                .select("document_id", F.col("id").alias("chunk_id"), F.lit("summary").alias("kind"),
                        "text", "_bad", F.col("_metadata.file_path").alias("file")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return chunks  # no summaries appended yet
    return chunks.unionByName(summ)
