"""Dense, ordered ids and running sums over keys of any type, without a
single-task window.

Rows are dealt into key ranges (a sampled range partitioning), each range is
summed by itself, and the totals of the ranges before are added back. The
dealt rows are written once, so that every later step sees the same ranges.
Keys may be numbers, strings, hashes or several columns; how close together
they lie doesn't matter.

Only the range totals, one row per ``2 ** RANGE_SHIFT`` rows, pass through the
driver (10^10 rows: some 20,000 totals).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_SHIFT = 19
RANGE = "_range"


def range_offsets(df: DataFrame, keys: Sequence[str], n: str | None = None, offset_col: str = "offset",
                  shift: int = RANGE_SHIFT) -> DataFrame:
    """``df`` with ``offset_col``: the sum of column ``n`` (of ones, without it)
    over all rows of smaller ``keys``, nulls first. Rows of equal keys lie in one range
    and follow each other in any order, so ``keys`` should tell rows apart; a range
    holds about 2 ** ``shift`` rows;
    null ``n`` counts 0; an empty table stays empty."""
    from docsift.session import cut_lineage
    ranges = max(1, math.ceil(df.count() / (1 << shift)))
    dealt = df.repartitionByRange(ranges, *keys) if ranges > 1 else df
    dealt = cut_lineage(dealt.withColumn(RANGE, F.spark_partition_id() if ranges > 1 else F.lit(0)), "ranges")
    amount = F.lit(1) if n is None else F.coalesce(F.col(n), F.lit(0))
    totals, before, start = dealt.groupBy(RANGE).agg(F.sum(amount).cast("bigint").alias("n")).collect(), [], 0
    for r in sorted(totals, key=lambda r: r[RANGE]):
        before.append((r[RANGE], start))
        start += r["n"]
    starts = df.sparkSession.createDataFrame(before, f"{RANGE} int, _start bigint")
    within = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
            .join(F.broadcast(starts), RANGE)  # one row a range
            .withColumn(offset_col, (F.col("_start") + F.col("_within")).cast("bigint"))
            .drop(RANGE, "_start", "_within"))


def running_offsets(counts: DataFrame, key: str, n: str, shift: int = RANGE_SHIFT) -> DataFrame:
    """``counts(key, n)`` -> ``(key, n, offset)`` where ``offset`` is the sum
    of ``n`` over all rows with a smaller key. ``key`` must be unique."""
    return range_offsets(counts.select(key, n), [key], n, shift=shift).select(key, n, "offset")


def dense_ids(df: DataFrame, keys: Sequence[str], id_col: str = "id", tie_cols: Sequence[str] = (),
              shift: int = RANGE_SHIFT) -> DataFrame:
    """``df`` with 1-based ids in the order of ``keys``, then ``tie_cols``. Rows equal
    in all of them get ids that follow each other in any order."""
    out = range_offsets(df, [*keys, *tie_cols], offset_col=id_col, shift=shift)
    return out.withColumn(id_col, F.col(id_col) + 1)


def dense_rank_ids(df: DataFrame, key: str, id_col: str = "id", shift: int = RANGE_SHIFT) -> DataFrame:
    """``df`` with 1-based dense ids in ``key`` order, one id for all rows of a
    key. Keys are counted before they are dealt, so a key on a third of all rows is one row there."""
    keys = range_offsets(df.groupBy(key).agg(F.lit(1).alias("_one")).select(key), [key],
                         offset_col="_id", shift=shift)
    ids = keys.select(F.col(key).alias("_key"), (F.col("_id") + 1).alias(id_col))
    return df.join(ids, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
