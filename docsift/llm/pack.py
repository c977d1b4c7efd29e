"""Best-fit packing by exact complements.

Documents become token ids with a separator; only documents longer than the
capacity are cut. Packing needs nothing but how many pieces there are of each
length, a table of at most ``capacity`` rows whatever the corpus holds:

1. Exact complements: from the longest pieces down, the gap a piece leaves is
   looked up among single lengths, sums of two and sums of three; a
   combination that fills it exactly is consumed as often as the counts allow.
2. The rest goes by best fit, longest first, into the smallest gap that
   takes it.

The result is a list of bin patterns with repeat counts. Each pattern slot
owns a range of its length's ranks; a piece finds its place by its rank among
pieces of its length. Ranks come from counts by (length, bucket), with as many
buckets as keep each small, so one common length isn't one task's work.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import stored, table, worker_memo

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "word_bpe_49k.json"
BUCKET_ROWS = 50_000
MEMO_WORDS = 600_000


class WordIds:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins across it, so
    a text's ids are those of its ASCII-white-space-separated words in turn.
    Words seen before come from a memo, which takes no more once it holds
    ``MEMO_WORDS``; new words are encoded many at a time. A word that ends in
    ASCII punctuation after an ASCII letter or digit is cut there, as the
    tokenizer cuts it. Texts that may hold a special token are not lower-cased."""

    CLOSING = re.compile(rb"[.,!?;:%$&*#)](?<=[0-9A-Za-z].)[.,!?;:%$&*#)]*+(?!\S)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        for i in range(0, len(words), 1000):
            part = words[i:i + 1000]
            texts = [w.decode() for w in part]
            ends = np.cumsum([len(t) + 1 for t in texts])
            e = self.tok.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4").tobytes()
            cut = np.searchsorted([o[0] for o in e.offsets], ends) * 4
            at = 0
            for w, to in zip(part, cut.tolist()):
                out[w] = ids[at:to]
                at = to
        return out

    def _learned(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the memo lacks; it keeps them while it has room."""
        new = self._encode(list(words))
        room = MEMO_WORDS - len(self.memo)
        if room > 0:
            self.memo.update(new if len(new) <= room else islice(new.items(), room))
        return new

    def __call__(self, texts: list) -> Iterator[bytes]:
        texts, known = list(texts), self.memo.get
        for i in range(0, len(texts), 256):  # of so many texts at a time the words are held one by one
            part, unknown = [], set()
            for text in texts[i:i + 256]:
                raw = (text or "").encode()
                words = self.CLOSING.sub(rb" \g<0>", raw if b"<|" in raw else raw.lower()).split()
                ids = list(map(known, words))  # each word is looked up once: None where the memo lacks it
                lacks = [w for w, x in zip(words, ids) if x is None]
                unknown.update(lacks)
                part.append((words, ids) if lacks else (None, b"".join(ids)))
            new = self._learned(unknown) if unknown else {}
            for words, ids in part:
                yield ids if words is None else b"".join([new[w] if x is None else x for w, x in zip(words, ids)])


def _tokenizer(path: str) -> WordIds:
    """One per Python worker, so that a later task finds the words of earlier ones."""
    return worker_memo(("pack", path), lambda: WordIds(path))


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt[, ids]) of every whole
    document: its ids and the separator, cut every ``capacity`` tokens. ``salt`` numbers
    a task's pieces and only spreads them over buckets."""
    step = 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, salt = _tokenizer(path), 0
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b["doc"], tok(b["text"])):
                ids += SEPARATOR.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), salt)
                                + ((np.frombuffer(part, "<u4").astype("int64"),) if keep_ids else ()))
                    salt += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                               + ["ids"] * keep_ids)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
              + ", ids array<bigint>" * keep_ids)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def _exact_fill(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to ``gap``; the longest
    first piece wins. ``left`` counts what is available by length."""
    if gap < 1:
        return None
    if left[gap]:
        return [gap]
    have = left > 0

    def pair(total: int, most: int) -> int:
        """The larger of two available lengths up to ``most`` that sum to ``total``; 0 if none."""
        hi = min(most, total - 1)
        lo = (total + 1) // 2
        if hi < lo:
            return 0
        a = np.arange(hi, lo - 1, -1)
        ok = have[a] & have[total - a]
        if total % 2 == 0:
            ok[-1] &= left[total // 2] >= 2
        i = int(ok.argmax())
        return int(a[i]) if ok[i] else 0

    if a := pair(gap, gap):
        return [a, gap - a]
    for a in np.nonzero(have[:gap - 1])[0][::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        rest = gap - a
        b = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)  # the larger of the two others
        c = rest - b
        ok = (left[b] > (b == c)) & have[c] & (left[a] > (b == a).astype(int) + (c == a))
        if ok.any():
            i = int(ok.argmax())
            return [a, int(b[i]), int(c[i])]
    return None


def bin_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """counts: pieces by length -> [([(length, times), ...], bins), ...].
    Works on counts alone: at most a few steps for each length there is."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def pattern(lengths: list[int]) -> list[tuple[int, int]]:
        runs: list[tuple[int, int]] = []
        for x in lengths:
            runs = runs[:-1] + [(x, runs[-1][1] + 1)] if runs and runs[-1][0] == x else runs + [(x, 1)]
        return runs

    for length in range(capacity, 0, -1):  # exact complements
        while left[length]:
            left[length] -= 1  # the piece itself can't fill its own gap
            rest = [] if length == capacity else _exact_fill(left, capacity - length)
            left[length] += 1
            if rest is None:
                break
            runs = pattern(sorted([length, *rest], reverse=True))
            n = min(int(left[x]) // times for x, times in runs)
            for x, times in runs:
                left[x] -= n * times
            out.append((runs, n))

    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # best fit: bins by what they still take
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in gaps if g >= length), default=0)
            if gap:
                runs, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                times = gap // length  # the bin just filled stays the best fit for the next of this length
            else:
                runs, bins, times = [], max(1, -(-n // (capacity // length))), capacity // length
                gap = capacity
            full = min(bins, n // times)
            parts = [(full, times)] if full else []
            if full < bins and n - full * times:  # what is left goes into one more bin
                parts.append((1, min(times, n - full * times)))
            for k, t in parts:
                if gap - t * length:
                    gaps.setdefault(gap - t * length, []).append((runs + [(length, t)], k))
                else:
                    out.append((runs + [(length, t)], k))
                bins -= k
                n -= k * t
            if bins and runs:
                gaps.setdefault(gap, []).append((runs, bins))
    return out + [x for same in gaps.values() for x in same]


def slot_table(patterns: list) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times, first sequence, offset) by slot."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for runs, bins in patterns:
        offset = 0
        for length, times in runs:
            first = used.get(length, 0)
            out.append((length, first, bins * times, times, sequence, offset))
            used[length] = first + bins * times
            offset += length * times
        sequence += bins
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``pieces`` (a stored table of tokenized_pieces) with sequence_id and
    offset: every piece in one sequence of at most ``capacity`` tokens, offsets
    gapless from 0. An empty table gives no rows."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows come to the driver, however many pieces there are.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(bin_patterns(counts, capacity))
    slots = spark.createDataFrame(slots, "length long, first long, ranks long, times long, sequence long, at long")
    buckets = max(1, math.ceil(sum(counts.values()) / bucket_rows))
    p = pieces.withColumn("bucket", F.pmod("salt", F.lit(buckets)))
    sums = (p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
            .select("length", "bucket", (F.sum("n").over(
                Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before")))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (p.withColumn("rank", F.row_number().over(within) - 1)
              .join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")))
    # A length has a row for each pattern that uses it: bounded by the capacity.
    s = F.broadcast(slots.withColumnRenamed("length", "s_length"))
    nth = F.col("rank") - F.col("first")
    return (ranked.join(s, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("first"))
                        & (F.col("rank") < F.col("first") + F.col("ranks")))
            .withColumns({"sequence_id": F.col("sequence") + F.floor(nth / F.col("times")),
                          "offset": F.col("at") + F.col("length") * (nth % F.col("times"))})
            .select(*[c for c in pieces.columns if c != "salt"], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack every document. Null and empty texts are the
    separator alone; repeated documents are packed each; a null id stays null;
    other columns are not read."""
    pieces = stored(tokenized_pieces(docs, path, capacity, keep_ids, id_col, text_col), "pieces")
    return packed(pieces, capacity)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


QUERIES = {"op10_best_fit_pack": op10_best_fit_pack}
SQL: dict[str, str] = {}
