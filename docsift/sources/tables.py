"""Tables as Parquet snapshots.

Parquet tables reject SQL UPDATE/DELETE and a table cannot be overwritten
while it is being read, so every change produces a new snapshot directory
(under the shared checkpoint folder unless a path is given) that is read
back. Changes are set-at-a-time column expressions, never row loops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import scratch_path


def create_table(spark: SparkSession, name: str, ddl: str, location: str | None = None) -> None:
    """Idempotent create (``ddl`` like 'id BIGINT, text STRING')."""
    loc = location or scratch_path(spark, f"table-{name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet LOCATION '{loc}'")


def drop_table(spark: SparkSession, name: str) -> None:
    """Idempotent drop."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def insert_rows(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Bulk append (columns matched by name)."""
    cols = spark.table(name).columns
    rows.select(*cols).write.insertInto(name)


def snapshot(df: DataFrame, name: str = "snapshot", path: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh directory and read it back."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_rows(df: DataFrame, cond: Column | None = None) -> DataFrame:
    """Without a condition everything goes; otherwise the rows where the
    condition is true go (a NULL condition keeps the row, as SQL DELETE)."""
    if cond is None:
        return df.limit(0)
    return df.filter(~F.coalesce(cond, F.lit(False)))


def update_rows(df: DataFrame, column: str, value, where_col: str, where_value) -> DataFrame:
    """Set ``column`` to ``value`` where ``where_col`` equals ``where_value``."""
    hit = F.coalesce(F.col(where_col) == F.lit(where_value), F.lit(False))
    return df.withColumn(column, F.when(hit, F.lit(value).cast(df.schema[column].dataType))
                         .otherwise(F.col(column)))


def update_from(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """A9 for many updates at once: join an updates table (key, column)."""
    u = updates.select(key, F.col(column).alias("_new"))
    return (df.join(u, key, "left")
            .withColumn(column, F.coalesce(F.col("_new"), F.col(column))).drop("_new")
            .select(*df.columns))


def select_where(df: DataFrame, **equals) -> DataFrame:
    """B1: all columns, AND-ed equality conditions on the given columns."""
    conds = [F.col(c) == F.lit(v) for c, v in equals.items() if v is not None]
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


# --------------------------------------------------------------- A10 index
def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row (n_rows, digest) that changes whenever a chunk is added,
    removed or edited."""
    return chunks.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.bit_xor(F.xxhash64("chunk_id", "text")).alias("digest"))


def save_index(tables: dict[str, DataFrame], chunks: DataFrame, path: str) -> None:
    """A10: persist index tables next to the fingerprint of the corpus they
    were built from."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    fingerprint(chunks).write.mode("overwrite").parquet(f"{path}/_fingerprint")


def load_index(spark: SparkSession, path: str, names: list[str], chunks: DataFrame):
    """A10: reload the index if it exists and matches the corpus; None when
    it is absent or stale (the caller rebuilds)."""
    try:
        stored = spark.read.parquet(f"{path}/_fingerprint").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    now = fingerprint(chunks).first()
    if stored is None or tuple(stored) != tuple(now):
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
