"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back:
    computed once, and later stages survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of two numbers that a broadcast may hold.
BROADCAST_ROWS = 500_000


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a few numbers a row, with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_KEPT: dict = {}


def worker_memo(key: tuple | None, make: Callable[[], object] = lambda: None) -> object:
    """What a Python worker keeps for its later tasks, of one operator at a time: workers serve
    all stages of a session, and what an earlier stage kept would count against the memory of the
    others. Kernels that keep nothing ask for ``None``."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def training_row(id_col: Column) -> Column:
    """Rows that models may learn from: crc32(id as text) mod 3 is not 1."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def held_out(id_col: Column) -> Column:
    """crc32(id as text) mod 3 is 1; a null id counts as not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
