"""Exploding computed arrays without evaluating them twice.

For ``explode``/``posexplode`` Catalyst infers a ``size(arr) > 0`` filter
below the generator and inlines the array expression into it, so an
expensive array (tokenising, chunking, HTML parsing) would be computed
once for the filter and once for the generator. The ``_outer`` generators
get no inferred filter; the empty/NULL case gives one NULL element, which
is dropped right after (our arrays never hold NULL elements).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(arr).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, arr: Column, pos: str, name: str) -> DataFrame:
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, name))
            .filter(F.col(name).isNotNull()))


def runs(sorted_rows: Column, field: str | None = None) -> Column:
    """The runs of equal elements (of equal ``field``, for structs) in a sorted array:
    array<struct<start, n>>, start from 1. Give a column, not a computed array: it is
    read once per element."""
    n = F.size(sorted_rows)

    def at(i):
        x = F.element_at(sorted_rows, i)
        return x if field is None else x[field]
    first = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
                     lambda i: (i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(first, 2, n), F.array(n + 1))
    return F.zip_with(first, F.when(n > 0, ends).otherwise(first), lambda a, b: F.struct(a.alias("start"), (b - a).alias("n")))
