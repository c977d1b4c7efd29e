"""Cross-tokenizer alignment with corpus-wide link counts.

Two tokenizers cut the same bytes. Where tokens of both end, a group ends;
tokens whose byte ranges overlap are linked.

1. The first pass aligns every text, counts in each task the id pairs it links, and keeps
   with every text its distinct pairs and how often it links each.
2. The distinct pairs get a minimal perfect hash: pairs are dealt into
   buckets, and a bucket sets, level by level, one bit for each pair that is alone at
   its place; a pair's slot is the number of bits before its own. The keys,
   in slot order, verify every lookup.
3. Counts become dense vectors by slot: one for a bucket and ``FAN`` tasks, then
   sums of ``FAN`` vectors, round by round, until a bucket has one.
4. The second pass looks up the counts of every text's kept pairs; no text is aligned again.

Both tokenizers cut at a single space between two other characters, whatever stands around
it, so texts are aligned in units of that kind, the distinct units of some texts at a time, as
one byte string; a task remembers, up to a bound, those that come again. The table of pairs is at most the product of two
vocabularies; up to ``BROADCAST_PAIRS`` it is broadcast, beyond that texts' pairs meet it in a join.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import stored, table
from docsift.llm.pack import tokenizer_path
from docsift.session import cut_lineage

A_TOKENIZER, B_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPREAD = 1 << 16
BUCKET_PAIRS = 50_000
FAN = 16
BROADCAST_PAIRS = 4_000_000
#: Characters that a task aligns at a time.
PART_CHARS = 5_000_000
#: Units that a task remembers, and their longest.
MEMO_UNITS = 120_000
MEMO_CHARS = 40
#: Pairs a task gathers before it hands them on.
TASK_PAIRS = 500_000
#: Kept pairs that a task looks up at a time.
PART_PAIRS = 1_000_000
SHIFT = 32

_BORDER = re.compile(r"(?<=\S) (?=\S)")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(seed + 1) * _M[0]
        x = (x ^ (x >> np.uint64(30))) * _M[1]
        x = (x ^ (x >> np.uint64(27))) * _M[2]
        return x ^ (x >> np.uint64(31))


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable
    Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligned:
    """Alignments of units: n_a, n_b, n_groups, n_links (0 for units of which a tokenizer
    doesn't keep the bytes, where ``ok`` is false); the linked pairs of the units in
    ``order``, one after the other, a unit's from ``start``; and the text of each one's
    groups, each group ended by a semicolon."""

    def __init__(self, size: int):
        self.ok = np.ones(size, bool)
        self.counts = np.zeros((size, 4), np.int64)
        self.order, self.start = np.arange(size), np.zeros(size, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.texts: list[bytes] = [b""] * size

    def placed(self) -> "Aligned":
        n = self.counts[self.order, 3]
        self.start[self.order] = np.cumsum(n) - n
        return self


class Tables:
    """Two tokenizers and what their vocabularies say; loaded once a worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_characters()
        entries = self.a.get_vocab()
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            self.a_bytes[i] = bytes(chars[c] for c in t)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))
        #: An id as text, within a group and at its end; A's ids first.
        self.written = [f"{i}{end}".encode() for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
                        for i in range(n) for end in ends]
        pre = json.loads(self.a.to_str())["pre_tokenizer"] or {}
        across = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        #: Units are alike in any text only if no token may span a border.
        self.in_units = pre.get("type") == "ByteLevel" and pre.get("use_regex", False) and not across

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()


_tables = functools.lru_cache(maxsize=1)(Tables)


class Aligner:
    """Aligns texts in units; one for each task. Units that some texts hold more than once
    are remembered, up to a bound."""

    def __init__(self, a_path: str, b_path: str):
        self.__dict__.update(_tables(a_path, b_path).__dict__)
        self.memo: dict[str, tuple] = {}

    def units(self, text: str) -> list[str]:
        return _BORDER.split(text) if self.in_units else [text]

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A's ids, how many of each unit, B's ids, how many of each unit). Units with
        a border at either end are read as one text; the others one by one."""
        got: list[tuple] = []
        run: list[str] = []
        for u in units:
            if not self.in_units or u[:1].isspace() or u[-1:].isspace() or "▁" in u:
                got += [*self._run(run), self._one(u)]
                run = []
            else:
                run.append(u)
                if len(run) == 2000:
                    got += self._run(run)
                    run = []
        got += self._run(run)
        none = [np.zeros(0, np.int64)] * 4
        return tuple(np.concatenate(x) for x in zip(none, *got))

    def _one(self, unit: str) -> tuple:
        a = self.a.encode(" " + unit, add_special_tokens=False).ids
        b = self.b.encode(unit)
        return np.array(a, np.int64), np.array([len(a)]), np.array(b, np.int64), np.array([len(b)])

    def _run(self, units: list[str]) -> list[tuple]:
        if not units:
            return []
        text = " ".join(units)
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        out = []
        for ids, size in ((a, self.a_size), (b, self.b_size)):
            upto = np.cumsum(size[ids])
            last = np.minimum(np.searchsorted(upto, ends), len(upto) - 1)
            if (upto[last] != ends).any():  # a tokenizer that doesn't keep the bytes
                return [self._one(u) for u in units]
            out += [ids, np.diff(last + 1, prepend=0)]
        return [tuple(out)]

    def aligned(self, units: list[str], times: np.ndarray | None = None) -> Aligned:
        """``times``: how often each unit occurs."""
        out, memo = Aligned(len(units)), self.memo
        known = [memo.get(u) for u in units]
        old = [k for k, m in enumerate(known) if m is not None]
        new = [k for k, m in enumerate(known) if m is None]
        made = self._aligned([units[k] for k in new])
        at = np.array(new, np.int64)
        out.ok[at], out.counts[at] = made.ok, made.counts
        for k, t in zip(new, made.texts):
            out.texts[k] = t
        if old:
            out.counts[old] = [known[k][0] for k in old]
            for k in old:
                out.texts[k] = known[k][2]
        out.pairs = np.concatenate([*(known[k][1] for k in old), made.pairs])
        out.order = np.concatenate([np.array(old, np.int64), at[made.ok]])
        if times is not None and len(memo) < MEMO_UNITS:
            often = [(k, i) for i, k in enumerate(new) if times[k] > 1 and made.ok[i] and len(units[k]) <= MEMO_CHARS]
            for k, i in often[:MEMO_UNITS - len(memo)]:
                lo, n = made.start[i], made.counts[i, 3]
                memo[units[k]] = (tuple(made.counts[i].tolist()), made.pairs[lo:lo + n].copy(), made.texts[i])
        return out.placed()

    def _aligned(self, units: list[str]) -> Aligned:
        """Units one after the other are one byte string, in which every unit ends a group."""
        out = Aligned(len(units))
        a, n_a, b, n_b = self._encoded(units)
        raw = [b" " + u.encode() for u in units]
        whole = b"".join(raw)
        if (b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole
                or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole):
            i = j = 0
            for k, (x, n, m) in enumerate(zip(raw, n_a.tolist(), n_b.tolist())):
                out.ok[k] = (b"".join(map(self.a_bytes.__getitem__, a[i:i + n].tolist())) == x
                             == b"".join(map(self.b_bytes.__getitem__, b[j:j + m].tolist())))
                i, j = i + n, j + m
            a, b = a[np.repeat(out.ok, n_a)], b[np.repeat(out.ok, n_b)]
            n_a, n_b = n_a[out.ok], n_b[out.ok]
        out.order = np.nonzero(out.ok)[0]
        if not len(a):
            return out
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first = np.searchsorted(b_end, a_end - self.a_size[a], "right")  # B's tokens that an A token overlaps
        last = np.searchsorted(b_end, a_end)
        links = last - first + 1
        a_last, b_last = b_end[last] == a_end, a_end[np.searchsorted(a_end, b_end)] == b_end
        at = np.repeat(first - np.cumsum(links) + links, links) + np.arange(links.sum())
        out.pairs = np.repeat(a << SHIFT, links) | b[at]
        start = np.cumsum(n_a) - n_a
        out.counts[out.ok] = np.stack([n_a, n_b, np.add.reduceat(a_last.astype(np.int64), start),
                                       np.add.reduceat(links, start)], axis=1)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.empty(len(a) + len(b), np.int64)  # a group's A ids, then its B ids
        b_before, a_upto = np.searchsorted(b_group, a_group), np.searchsorted(a_group, b_group, "right")
        order[np.arange(len(a)) + b_before] = 2 * a + a_last
        order[np.arange(len(b)) + a_upto] = 2 * (len(self.a_bytes) + b) + b_last
        written, to = list(map(self.written.__getitem__, order.tolist())), 0
        for k, n in zip(np.nonzero(out.ok)[0].tolist(), (n_a + n_b).tolist()):
            out.texts[k] = b"".join(written[to:to + n])
            to += n
        return out.placed()

    def documents(self, texts: list[str | None]) -> tuple[Aligned, list[list[int] | None]]:
        """(alignments of the texts' distinct units, each text's units as
        positions there, None for a text without tokens)."""
        seen: dict[str, int] = {}
        place = seen.setdefault
        rows = [[place(u, len(seen)) for u in self.units(t)] if t else None for t in texts]
        times = np.bincount([k for r in rows if r is not None for k in r], minlength=len(seen))
        found = self.aligned(list(seen), times)
        if not found.ok.all():
            bad = set(np.nonzero(~found.ok)[0].tolist())
            rows = [None if r is None or not bad.isdisjoint(r) else r for r in rows]
        return found, rows


def _parts(texts: list[str | None]) -> Iterator[slice]:
    """Slices of at most 2048 texts and, but for a longer one, ``PART_CHARS`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and (k - start == 2048 or size + n > PART_CHARS):
            yield slice(start, k)
            start, size = k, 0
        size += n
    if start < len(texts):
        yield slice(start, len(texts))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))


def _text_pairs(found: Aligned, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, times, ends): the distinct pairs of each text, one text after the other up to its
    end, and how often the text links them."""
    sizes = np.array([len(r or ()) for r in rows], np.int64)
    unit = np.fromiter(chain.from_iterable(r or () for r in rows), np.int64, sizes.sum())
    n = found.counts[unit, 3]
    at = np.repeat(found.start[unit] - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys, code = np.unique(found.pairs, return_inverse=True)
    width = max(1, len(keys))
    cell, times = np.unique(np.repeat(np.repeat(np.arange(len(rows)), sizes), n) * width + code[at], return_counts=True)
    return keys[cell % width], times, np.searchsorted(cell, np.arange(1, len(rows) + 1) * width)


#: What the first pass writes: counts (part to n) and texts (row to times), either with nulls for the other.
_COUNTS = {"part": pa.int32(), "spread": pa.int32(), "pair": pa.int64(), "n": pa.int64()}
_TEXTS = {"row": pa.int64(), "doc": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
          "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
_PASS = ("part int, spread int, pair long, n long, row long, doc long, n_a long, n_b long, n_groups long, n_links long, "
         "groups_sha256 string, pairs binary, times binary")


def _batch(size: int, columns: dict) -> pa.RecordBatch:
    """All columns of the first pass, nulls where ``columns`` has none."""
    kinds = _COUNTS | _TEXTS
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()],
                                      list(kinds))


def first_pass(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text aligned once: rows (part, spread, pair, n) of the links that each task (``part``) counts,
    and for every text a row (row, doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) without a
    part; ``row`` is its own, ``pairs`` and ``times`` are 64-bit and 32-bit numbers, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, aligner = TaskContext.get().partitionId(), Aligner(a_path, b_path)
        row = part << 33
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parked: list[tuple[np.ndarray, np.ndarray]] = []

        def merged(parked: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([p for p, _ in parked]), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate([n for _, n in parked]))
            return keys, sums

        def frame() -> pa.RecordBatch:
            return _batch(len(pairs), {"part": np.full(len(pairs), part, np.int32), "pair": pairs, "n": counts,
                                       "spread": (_mix(pairs, 0) % np.uint64(SPREAD)).astype(np.int32)})

        for b in batches:
            doc, texts = b.column("doc"), b.column("text").to_pylist()
            for part_ in _parts(texts):
                found, rows = aligner.documents(texts[part_])
                linked, times, ends = _text_pairs(found, rows)
                yield _text_rows(row, doc.slice(part_.start, len(rows)), found, rows, linked, times, ends)
                row += len(rows)
                parked.append(merged([(linked, times)]))
                if sum(len(p) for p, _ in parked) > TASK_PAIRS:
                    pairs, counts = merged([(pairs, counts), *parked])
                    parked = []
                    if len(pairs) > TASK_PAIRS:
                        yield frame()
                        pairs, counts = pairs[:0], counts[:0]
        if parked:
            pairs, counts = merged([(pairs, counts), *parked])
        yield frame()

    return _rows(docs, id_col, text_col).mapInArrow(run, _PASS)


def _text_rows(row: int, doc: pa.Array, found: Aligned, rows: list, pairs: np.ndarray, times: np.ndarray,
               ends: np.ndarray) -> pa.RecordBatch:
    total = np.array([found.counts[r].sum(axis=0) if r is not None else np.zeros(4, np.int64) for r in rows]).reshape(-1, 4)
    sha = [hashlib.sha256(b"".join([found.texts[k] for k in r])[:-1]).hexdigest() if r is not None else "" for r in rows]
    cut = list(zip([0, *ends.tolist()], ends.tolist()))
    p, t = pairs.astype("<i8").tobytes(), times.astype("<i4").tobytes()
    columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), total.T))
    return _batch(len(rows), columns | {"row": np.arange(row, row + len(rows)), "doc": doc, "groups_sha256": sha,
                                        "pairs": [p[8 * x:8 * y] for x, y in cut], "times": [t[4 * x:4 * y] for x, y in cut]})


def _counts(passed: DataFrame) -> DataFrame:
    return passed.filter("part is not null").select(*_COUNTS)


def _texts(passed: DataFrame) -> DataFrame:
    return passed.filter("part is null").select(*_TEXTS)


def task_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, spread, pair, n) of the first pass alone."""
    return _counts(first_pass(docs, a_path, b_path, id_col, text_col))


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, words of bits) for distinct keys."""
    sizes, words = [], []
    while len(keys):
        m = 64 * max(1, math.ceil(1.2 * len(keys) / 64))
        at = (_mix(keys, len(sizes) + 1) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        bits = np.zeros(m, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        sizes.append(m)
        keys = keys[~alone]
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64)


class PairHash:
    """Slots of pairs by the hashes of one or more buckets, in bucket order."""

    def __init__(self, buckets: int, levels: list[list[int]], words: list[np.ndarray]):
        self.buckets = buckets
        depth = max((len(x) for x in levels), default=0)
        self.size = np.zeros((max(len(levels), 1), max(depth, 1)), np.int64)
        for i, x in enumerate(levels):
            self.size[i, :len(x)] = x
        self.base = (np.cumsum(self.size) - self.size.ravel()).reshape(self.size.shape)
        self.words = np.concatenate([*words, np.zeros(1, np.uint64)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, pairs: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """-1 for a pair that no level holds; the others are to be verified."""
        out = np.full(len(pairs), -1, np.int64)
        live = np.arange(len(pairs))
        for level in range(self.size.shape[1]):
            m = self.size[bucket[live], level]
            live, m = live[m > 0], m[m > 0]
            if not len(live):
                break
            at = self.base[bucket[live], level] + (_mix(pairs[live], level + 1) % m.astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[live[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            live = live[~hit]
        return out

    def verified(self, pairs: np.ndarray, bucket: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = self.slots(pairs, bucket)
        if len(at) and ((at < 0).any() or (keys[at] != pairs).any()):
            raise ValueError("a linked pair that the first pass did not count")
        return at


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((_mix(pairs, 0) % np.uint64(SPREAD)) // np.uint64(SPREAD // buckets)).astype(np.int64)


def hashed_pairs(partials: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sizes, bits, keys): each bucket's hash, keys in slot order."""
    def build(b: pd.DataFrame) -> pd.DataFrame:
        keys = b["pair"].to_numpy()
        sizes, words = perfect_hash(keys)
        ordered = np.empty_like(keys)
        ordered[PairHash(1, [sizes], [words]).slots(keys, np.zeros(len(keys), np.int64))] = keys
        return pd.DataFrame({"bucket": b["bucket"].iloc[:1].tolist(), "sizes": [sizes], "bits": [words.tobytes()],
                             "keys": [ordered.tobytes()]})

    return (partials.select("spread", "pair").distinct()
            .select(F.floor(F.col("spread") / (SPREAD // buckets)).cast("int").alias("bucket"), "pair")
            .groupBy("bucket").applyInPandas(build, "bucket int, sizes array<int>, bits binary, keys binary"))


def dense_counts(partials: DataFrame, hashes: DataFrame, buckets: int, fan: int = FAN) -> DataFrame:
    """(bucket, counts): dense vectors by slot, summed as a tree over the tasks' counts."""
    def dense(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        h = right.iloc[0]
        keys = np.frombuffer(h["keys"], np.int64)
        f = PairHash(1, [list(h["sizes"])], [np.frombuffer(h["bits"], np.uint64)])
        pairs, vector = left["pair"].to_numpy(), np.zeros(len(keys), np.int64)
        np.add.at(vector, f.verified(pairs, np.zeros(len(pairs), np.int64), keys), left["n"].to_numpy())
        return pd.DataFrame({"bucket": [h["bucket"]], "grp": [h["g"]], "counts": [vector.tobytes()]})

    def summed(b: pd.DataFrame) -> pd.DataFrame:
        vector = sum(np.frombuffer(c, np.int64) for c in b["counts"])
        return pd.DataFrame({"bucket": b["bucket"].iloc[:1].tolist(), "grp": b["grp"].iloc[:1].tolist(),
                             "counts": [vector.tobytes()]})

    schema = "bucket int, grp int, counts binary"
    p = partials.select(F.floor(F.col("spread") / (SPREAD // buckets)).cast("int").alias("bucket"),
                        F.floor(F.col("part") / fan).cast("int").alias("grp"), "pair", "n")
    wanted = hashes.join(p.select(F.col("bucket").alias("bucket"), F.col("grp").alias("g")).distinct(), "bucket")
    vectors = stored(p.groupBy("bucket", "grp").cogroup(wanted.groupBy("bucket", "g")).applyInPandas(dense, schema),
                     "count_vectors")
    groups = (partials.agg(F.max("part")).first()[0] or 0) // fan + 1
    while groups > 1:
        groups = -(-groups // fan)
        nodes = vectors.withColumn("grp", F.floor(F.col("grp") / fan).cast("int"))
        vectors = stored(nodes.groupBy("bucket", "grp").applyInPandas(summed, schema), "count_vectors")
    return vectors.select("bucket", "counts")


class PairTable:
    """Counts of pairs by slot, and whether one is the highest of its B id."""

    def __init__(self, rows: list, buckets: int):
        by = {r["bucket"]: r for r in rows}
        at = [by.get(k) for k in range(buckets)]
        self.buckets = buckets
        self.hash = PairHash(buckets, [list(r["sizes"]) if r else [] for r in at],
                             [np.frombuffer(r["bits"], np.uint64) for r in at if r])
        self.keys, self.counts = (np.concatenate([np.frombuffer(r[c], np.int64) for r in at if r] + [np.zeros(0, np.int64)])
                                  for c in ("keys", "counts"))
        ids = self.keys & ((1 << SHIFT) - 1)
        most = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
        np.maximum.at(most, ids, self.counts)
        self.best = self.counts == most[ids]

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        return self.hash.verified(pairs, _bucket_of(pairs, self.buckets), self.keys)


_OUT = "doc long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _numbers(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """The kept pairs of texts in turn, at most ``PART_PAIRS`` but for one text's: (the texts, pairs, times, ends)."""
    pairs, times = batch.column("pairs"), batch.column("times")
    sizes = [len(x) // 8 for x in pairs.to_pylist()]
    start = held = 0
    for k in range(len(sizes) + 1):
        if k == len(sizes) or (k > start and held + sizes[k] > PART_PAIRS):
            if k > start:
                yield (slice(start, k), np.frombuffer(b"".join(pairs[start:k].to_pylist()), "<i8"),
                       np.frombuffer(b"".join(times[start:k].to_pylist()), "<i4").astype(np.int64), np.cumsum(sizes[start:k]))
            start, held = k, 0
        if k < len(sizes):
            held += sizes[k]


def looked_up(texts: DataFrame, shared) -> DataFrame:
    """Second pass with the broadcast table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        names = [c.split()[0] for c in _OUT.split(", ")]
        for b in batches:
            sums = np.zeros((b.num_rows, 2), np.int64)
            for part, pairs, times, ends in _numbers(b):
                at = table.slots(pairs)
                upto = np.cumsum(np.stack([table.best[at] * times, table.counts[at] * times]), axis=1)
                sums[part] = np.diff(np.concatenate([np.zeros((2, 1), np.int64), upto], axis=1)[:, ends], axis=1,
                                     prepend=0).T
            found = {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else b.column(c) for c in names], names)

    return texts.drop("row").mapInArrow(run, _OUT)


def joined_up(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Second pass beyond the broadcast: every text's pairs meet (pair, n) in a join, which splits
    what one pair is too much for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row").to_numpy()
            for part, pairs, times, ends in _numbers(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[part], np.diff(ends, prepend=0))), pa.array(pairs),
                                                  pa.array(times)], ["row", "pair", "times"])

    most = pairs.groupBy((F.col("pair") % (1 << SHIFT)).alias("b")).agg(F.max("n").alias("most"))
    known = pairs.withColumn("b", F.col("pair") % (1 << SHIFT)).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    links = (texts.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long").join(known, "pair").groupBy("row")
             .agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"),
                  F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (texts.drop("pairs", "times").join(links, "row", "left")
            .select("doc", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(pair, n) of stored buckets (keys, counts)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, counts in zip(b["keys"], b["counts"]):
                yield pd.DataFrame({"pair": np.frombuffer(keys, np.int64), "n": np.frombuffer(counts, np.int64)})

    return counted.select("keys", "counts").mapInPandas(run, "pair long, n long")


def aligned(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS,
            bucket_pairs: int = BUCKET_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose bytes a tokenizer doesn't keep, have zeros, an
    empty groups_sha256, and count no links. Repeated rows count and are given each; a null id
    stays null; other columns are not read; an empty table gives no rows."""
    spark = docs.sparkSession
    passed = cut_lineage(first_pass(docs, a_path, b_path, id_col, text_col), "first_pass")
    partials, texts = _counts(passed), _texts(passed)
    n_pairs = partials.select("pair").distinct().count()
    buckets = 1 << min(16, max(0, math.ceil(math.log2(max(n_pairs / bucket_pairs, 1)))))
    hashes = stored(hashed_pairs(partials, buckets), "pair_hashes")
    counted = stored(hashes.join(dense_counts(partials, hashes, buckets), "bucket"), "pair_counts")
    if n_pairs > broadcast_pairs:
        out = joined_up(texts, stored(pair_counts(counted), "pair_counts"))
    else:
        shared = spark.sparkContext.broadcast(PairTable(counted.collect(), buckets))  # at most broadcast_pairs pairs
        out = stored(looked_up(texts, shared), "aligned")
        shared.destroy()
    return out.withColumnRenamed("doc", id_col)


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokenizer_path(A_TOKENIZER), tokenizer_path(B_TOKENIZER))


QUERIES = {"op12_align_tokenizers": op12_align_tokenizers}
SQL: dict[str, str] = {}
