"""Size-checked broadcast.

A side is broadcast only after a bounded count proves it small; otherwise
the join stays a shuffle join (and AQE may still turn it into a broadcast
from runtime statistics, or split skewed partitions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 1_000_000


def row_count_at_most(df: DataFrame, max_rows: int) -> int:
    """Counts at most ``max_rows + 1`` rows (the scan stops early)."""
    return df.limit(max_rows + 1).count()


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    return F.broadcast(df) if row_count_at_most(df, max_rows) <= max_rows else df
