"""Passages as rows of their counted words, and what an index makes of them.

A passage's words stay in its row: they are split by Spark expressions and
counted, looked up and inverted batch by batch in Arrow kernels, so that a
posting becomes a row only behind the one shuffle that the index needs, and
vectors need none. What a kernel has to know of the corpus is each word's df:
words of one passage alone are most of a vocabulary and need no entry, the
others are broadcast as two number columns (16 bytes a word) up to
``MAX_KNOWN_WORDS``; callers join by word beyond. Words are told apart there
by the first 64 bits of their md5, whose parts are their bucket and sign too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.functions.arrays import explode_rows
from docsift.operators.broadcast import row_count_at_most

MAX_KNOWN_WORDS = 8_000_000
POSTINGS_PER_BATCH = 1 << 21  # about so many are inverted at once


def _encoded(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a column of word lists: each word's row, its code, and the words by code."""
    lists = batch.column(name)
    words = lists.flatten().dictionary_encode()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), lengths), codes, words.dictionary


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, code, words = _encoded(batch, "toks")
        width = max(1, len(words))
        cell, tf = np.unique(row * width + code, return_counts=True)
        at = np.searchsorted(cell // width, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("chunk_id"), pa.array(np.bincount(row, minlength=batch.num_rows), pa.int32()),
             _lists(at, words.take(pa.array(cell % width))), _lists(at, pa.array(tf, pa.int32()))],
            ["chunk_id", "dl", "terms", "tfs"])


def count_words(psg: DataFrame) -> DataFrame:
    """(chunk_id, dl, terms, tfs) of every row of ``psg(chunk_id, text)``: its
    distinct words and their counts. A null text has no words."""
    id_type = psg.schema["chunk_id"].dataType.simpleString()
    toks = psg.select("chunk_id", F.coalesce(tx.bm25_tokens(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    return toks.mapInArrow(_count, f"chunk_id {id_type}, dl int, terms array<string>, tfs array<int>")


def postings(lists: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl) of ``count_words``."""
    rows = explode_rows(lists, ["chunk_id", "dl"], F.arrays_zip("terms", "tfs"), "t")
    return rows.select("chunk_id", F.col("t.terms").alias("term"), F.col("t.tfs").cast("bigint").alias("tf"), "dl")


# ------------------------------------------------------------ words' numbers
def word_key(term: Column) -> Column:
    h = F.md5(term)
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(part(1), 32).bitwiseOR(part(9))


def _keys(words: pa.Array) -> np.ndarray:
    """``word_key`` of every word."""
    digests = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:8] for w in words.cast(pa.binary()).to_pylist())
    return np.frombuffer(digests, ">i8").astype(np.int64)


def known_words(dfs: DataFrame, max_words: int | None = None):
    """Broadcast (keys in order, df) of the words of ``dfs(term, df)`` that more than one
    passage has; None where they are more than ``max_words``."""
    max_words = MAX_KNOWN_WORDS if max_words is None else max_words
    rows = dfs.filter("df > 1")
    if row_count_at_most(rows, max_words) > max_words:
        return None
    got = rows.select(word_key(F.col("term")).alias("key"), "df").toArrow()
    keys, df = got["key"].to_numpy(), got["df"].to_numpy()
    order = np.argsort(keys)
    return dfs.sparkSession.sparkContext.broadcast((keys[order], df[order]))


def _df(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """df of words by key; a word that isn't known is in one passage."""
    have, df = known
    if not len(have):
        return np.ones(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where(have[at] == keys, df[at], 1)


# ------------------------------------------------------------ inverted lists
def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to about POSTINGS_PER_BATCH, so that a word's rows are few."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("tfs").flatten())
        if size >= POSTINGS_PER_BATCH:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _inverted(known, first: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
        id_type, n_type = (types[t] for t in names)
        for batch in _gathered(batches):
            batch = batch.sort_by("chunk_id")  # a word's ids are in order: they take less
            row, code, words = _encoded(batch, "terms")
            order = np.argsort(code, kind="stable")
            at = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words)))])
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False).astype(np.int64) - first
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            dl = batch.column("dl").to_numpy(zero_copy_only=False)
            place = row[order]
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(_df(known.value, _keys(words)), pa.int64()), _lists(at, pa.array(ids[place]).cast(id_type)),
                 _lists(at, pa.array(tf[order]).cast(n_type)), _lists(at, pa.array(dl[place]).cast(n_type))],
                ["term", "df", "ids", "tfs", "dls"])
    return fn


def inverted(lists: DataFrame, known, first: int, last: int, longest: int) -> DataFrame:
    """(term, df, ids, tfs, dls): one row for a word and a batch of passages, in which
    a hot word's passages are as many as a batch has. ``ids`` count from the smallest id,
    ``first``; they, the counts and the lengths are as narrow as ``last`` and the
    ``longest`` passage's length let them be."""
    id_type = "int" if last - first < 1 << 31 else "bigint"
    n_type = "smallint" if longest < 1 << 15 else "int"
    return lists.mapInArrow(_inverted(known, first, [id_type, n_type]),
                            f"term string, df bigint, ids array<{id_type}>, tfs array<{n_type}>, dls array<{n_type}>")


def inverted_postings(rows: DataFrame, keep: list[str], first: int, id_type: str) -> DataFrame:
    """``keep`` and (chunk_id, tf, dl) of ``inverted``."""
    return (explode_rows(rows, keep, F.arrays_zip("ids", "tfs", "dls"), "t")
            .select(*keep, (F.col("t.ids") + F.lit(first).cast("bigint")).cast(id_type).alias("chunk_id"),
                    F.col("t.tfs").cast("bigint").alias("tf"), F.col("t.dls").cast("int").alias("dl")))


# ------------------------------------------------------------------ vectors
def _embedded(known, n: float, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, code, words = _encoded(batch, "terms")
            keys = _keys(words)
            bucket = ((keys >> 32) & 0xFFFFFFFF) % dim
            sign = np.where((keys >> 28) & 15 < 8, 1.0, -1.0)
            unit = sign * np.log(1.0 + n / _df(known.value, keys))
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            size = batch.num_rows * dim
            sums = np.bincount(row * dim + bucket[code], tf * unit[code], size).reshape(batch.num_rows, dim)
            norm = np.sqrt((sums * sums).sum(1, keepdims=True))
            vec = (sums / np.where(norm > 0, norm, 1.0)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), _lists(np.arange(0, size + 1, dim), pa.array(vec.reshape(-1)))], ["chunk_id", "vec"])
    return fn


def embed_lists(lists: DataFrame, known, n: float, dim: int) -> DataFrame:
    """(chunk_id, vec array<float>): the vectors of ``vectors.embed_corpus`` in the rows of
    ``count_words``, zero for a passage without words."""
    id_type = lists.schema["chunk_id"].dataType.simpleString()
    return lists.mapInArrow(_embedded(known, n, dim), f"chunk_id {id_type}, vec array<float>")
