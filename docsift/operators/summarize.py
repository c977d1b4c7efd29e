"""Default extractive summariser (used by C12 and H8).

Sentences are split on . ! ?; a sentence scores the mean, over its lexical
tokens, of how often the token occurs in the whole group; the best
``n_sent`` sentences (score, then position) are kept in their original
order and joined by '. '.

Groups meet once, whole, on their key (a group is bounded in size by
construction: five chunks, or one answer context); rows of one key are one
group. All that follows happens in the group's row: Spark expressions split it,
an Arrow kernel counts its words, so they are neither rows nor shuffled,
sorted or spilled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift.functions import text as tx

SENTENCE_SPLIT = r"[.!?]"


_COUNTS = T.ArrayType(T.StructType().add("sn", T.IntegerType()).add("total", T.LongType()).add("n", T.IntegerType()))
GROUPS_PER_SLICE = 1000


def _sentence_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of each group's ``toks`` (its sentences' words), ``counts``: of every sentence
    number with words, how many they are and how often they occur in the group, summed."""
    for whole in batches:
        for start in range(0, whole.num_rows, GROUPS_PER_SLICE):
            batch = whole.slice(start, GROUPS_PER_SLICE)
            sents, toks = batch.column("sents"), batch.column("toks")
            row = np.repeat(np.arange(batch.num_rows), _lengths(toks))
            number = sents.flatten().field("sn").to_numpy(zero_copy_only=False).astype(np.int64)
            by_sentence = toks.flatten()
            sentence = np.repeat(np.arange(len(row)), _lengths(by_sentence))
            words = by_sentence.flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, at, times = np.unique(row[sentence] * max(1, len(words.dictionary)) + code, return_inverse=True, return_counts=True)
            numbers = int(number.max(initial=0)) + 1
            unit, at_unit = np.unique(row[sentence] * numbers + number[sentence], return_inverse=True)
            total = np.bincount(at_unit, times[at], len(unit)).astype(np.int64)
            counts = pa.StructArray.from_arrays(
                [pa.array(unit % numbers, pa.int32()), pa.array(total), pa.array(np.bincount(at_unit, minlength=len(unit)), pa.int32())],
                ["sn", "total", "n"])
            offsets = np.searchsorted(unit // numbers, np.arange(batch.num_rows + 1))
            keep = [c for c in batch.schema.names if c != "toks"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), counts)], [*keep, "counts"])


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def extractive_summary(df: DataFrame, keys: list[str], text_col: str = "text",
                       n_sent: int = tx.SUMMARY_SENTENCES,
                       out_col: str = "summary") -> DataFrame:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    # a null key is no group: such rows get an empty summary, and their texts aren't gathered
    groups = df.groupBy(*keys).agg(F.collect_list(F.when(known, F.col(text_col))).alias("_texts"),
                                   F.count(F.lit(1)).cast("int").alias("_n"))

    def with_columns(d: DataFrame, **cols) -> DataFrame:
        return d.select(*keys, "_n", *[c.alias(name) for name, c in cols.items()])

    def sentences(text):
        parts = F.transform(F.split(text, SENTENCE_SPLIT), lambda s, i: F.struct(i.alias("sn"), F.trim(s).alias("s")))
        return F.filter(parts, lambda x: x["s"] != "")

    d = with_columns(groups, sents=F.sort_array(F.flatten(F.transform("_texts", sentences))))
    # a sentence's words go with it, and are counted over the group in its row
    d = with_columns(d, sents=F.col("sents"), toks=F.transform("sents", lambda x: tx.bm25_tokens(x["s"])))
    schema = T.StructType([f for f in d.schema if f.name != "toks"]).add("counts", _COUNTS)
    d = d.mapInArrow(_sentence_counts, schema)
    mean = F.transform("counts", lambda r: F.struct(
        (-F.round(r["total"].cast("double") / r["n"], 6)).alias("less"), r["sn"].alias("sn")))
    best = F.slice(F.sort_array(mean), 1, n_sent)
    d = with_columns(d, sents=F.col("sents"), best=F.sort_array(F.transform(best, lambda x: x["sn"])))
    text = F.array_join(F.transform("best", lambda sn: F.array_max(F.transform(
        F.filter("sents", lambda x: x["sn"] == sn), lambda x: x["s"]))), ". ")
    out = d.select(*keys, F.when(F.size("best") > 0, F.concat(text, F.lit("."))).otherwise(F.lit("")).alias(out_col),
                   F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    return out.drop("_copy")
