"""Ranked lexical search: short lists term at a time, long lists document at a time.

1. Index: documents are gathered in blocks of at most ``BLOCK_DOCS``; a block is
   one row with its documents' lengths and, for each query term, the list of
   (document, occurrences). The scan that tokenises whole texts builds it, so no
   posting is ever shuffled. Corpus numbers (documents, words, document
   frequencies) are aggregates of the blocks.
2. Term at a time: the lists that are short over the corpus (a document
   frequency of at most 1 / ``SHORT_SHARE`` of the documents) are summed into
   accumulators, materialised for each block and item. The k-th best accumulator
   of an item is a score that its answer reaches in any case.
3. Document at a time: an item's accumulators are one iterator, bounded by their
   greatest sum, beside the iterators of its long lists, each bounded by its
   greatest part of a score in every range of ``RANGE_DOCS`` documents. Ranges whose bounds
   don't add up to the item's threshold are skipped, in all lists at once;
   what is left is scored in full, range by range, and the threshold rises
   with the answers found so far.
4. A task keeps its best k of each item; a window keeps the best of all tasks.

Scores are whole numbers, so a bound never excludes a score that equals it, and
equal scores go by document id. Postings live only inside blocks, so a term of
every document, or a document of many copies, is work for all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import ascii_lower, stored, table

K = 20
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1_000_000
RANGE_DOCS = 64
SHORT_SHARE = 64
#: Rows of (item, term) that one pass broadcasts; more items are ranked in several passes.
PASS_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_SEPARATORS = [b for b in range(128) if not chr(b).isalnum()]
#: Separators become spaces, A-Z lower case; bytes of other characters stay.
_BYTES = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode().translate(_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, q): items of equal id and text are one."""
    words = F.coalesce(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return (items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
            .select("item_id", F.xxhash64("item_id", "text").alias("item"), F.explode(words).alias("word"))
            .groupBy("item", "item_id", ascii_lower(F.col("word")).alias("term")).agg(F.count("*").alias("q")))


_BLOCK = ("block long, docs binary, no_id binary, lengths binary, terms binary, starts binary, ordinals binary, tfs binary")


def block_index(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block. docs, no_id, lengths: by ordinal; terms: those of the
    block's lists, list i being ordinals and tfs from starts[i] to starts[i + 1].
    ``vocabulary`` broadcasts {term: number}."""

    def block(number: int, parts: list[tuple]) -> pd.DataFrame:
        ids, none, lengths, terms, ordinals, tfs, at = [], [], [], [], [], [], 0
        for doc, null, n, t, o, f in parts:
            ids.append(doc), none.append(null), lengths.append(n)
            terms.append(t), ordinals.append(o + at), tfs.append(f)
            at += len(n)
        terms, ordinals, tfs = (np.concatenate(x) for x in (terms, ordinals, tfs))
        order = np.argsort(terms, kind="stable")
        found, starts = np.unique(terms[order], return_index=True)
        arrays = (np.concatenate(ids), np.concatenate(none), np.concatenate(lengths), found.astype(np.int32),
                  np.append(starts, len(terms)).astype(np.int32), ordinals[order].astype(np.int32), tfs[order].astype(np.int32))
        return pd.DataFrame([[number, *(a.tobytes() for a in arrays)]],
                            columns=["block", "docs", "no_id", "lengths", "terms", "starts", "ordinals", "tfs"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        get, width = vocabulary.value.get, len(vocabulary.value) + 1
        parts, n_docs, n_postings = [], 0, 0
        for b in batches:
            null = b["doc"].isna().to_numpy()
            doc = b["doc"].astype("Int64").fillna(0).to_numpy(np.int64)
            texts = b["text"]
            for i in range(0, len(b), 256):
                numbers, ends = [], []
                for t in texts.iloc[i:i + 256]:
                    numbers.extend([get(w, -1) for w in words_of(t)])
                    ends.append(len(numbers))
                v = np.array(numbers, dtype=np.int64)
                n = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), n)
                known = v >= 0
                pair, tf = np.unique(owner[known] * width + v[known], return_counts=True)
                parts.append((doc[i:i + 256], null[i:i + 256], n.astype(np.int64), pair % width, pair // width, tf))
                n_docs, n_postings = n_docs + len(ends), n_postings + len(pair)
                if n_docs > BLOCK_DOCS - 256 or n_postings > BLOCK_POSTINGS:
                    yield block(number, parts)
                    number, parts, n_docs, n_postings = number + 1, [], 0, 0
        if parts:
            yield block(number, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, _BLOCK)


def _ints(raw: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(raw, kind)


def corpus_numbers(index: DataFrame) -> tuple[DataFrame, int, int]:
    """((term number, df), documents with a term, words of all)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for terms, starts, lengths in zip(b["terms"], b["starts"], b["lengths"]):
                n = _ints(lengths, np.int64)
                yield pd.DataFrame({"number": np.append(_ints(terms), [-1, -2]),
                                    "df": np.append(np.diff(_ints(starts)).astype(np.int64), [(n > 0).sum(), n.sum()])})

    sums = stored(index.select("terms", "starts", "lengths").mapInPandas(run, "number int, df long")
                  .groupBy("number").agg(F.sum("df").alias("df")), "term_counts")
    whole = {r["number"]: r["df"] for r in sums.filter("number < 0").collect()}
    return sums.filter("number >= 0"), whole.get(-1, 0), whole.get(-2, 0)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Plan:
    """What every task needs to know of the items: CSR rows of (term, weight
    times occurrences in the item), short and long lists apart."""

    def __init__(self, rows: list[tuple[int, int, int]], dfs: dict[int, int], n_docs: int, n_words: int, n_items: int,
                 n_terms: int):
        self.n_docs, self.n_words, self.n_items, self.n_terms = n_docs, n_words, n_items, n_terms
        self.short = np.array([dfs.get(t, 0) * SHORT_SHARE <= n_docs for t in range(n_terms)], dtype=bool)
        rows = sorted(r for r in rows if dfs.get(r[1], 0))
        self.item = np.array([r[0] for r in rows], dtype=np.int64)
        self.term = np.array([r[1] for r in rows], dtype=np.int64)
        self.weight = np.array([weight(n_docs, dfs[r[1]]) * r[2] for r in rows], dtype=np.int64)

    def parts(self, lengths: np.ndarray, ordinals: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """The part of a score that an occurrence list gives, before its weight."""
        m = 75 + (25 * lengths * self.n_docs) // max(self.n_words, 1)
        tf = tfs.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m[ordinals])


def _best(docs: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, equal scores by id, null ids last."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= least)[0]
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((docs[at], none[at], -scores[at]))[:k]]


class Best:
    """The k best of every item that a task has met."""

    def __init__(self, n_items: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.ones(n_items, np.int64) if floor is None else np.maximum(floor, 1)
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.rows = [empty] * n_items

    def add(self, item: int, docs: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        ok = scores >= self.floor[item]
        if not ok.any():
            return
        joined = [np.concatenate(x) for x in zip(self.rows[item], (docs[ok], none[ok], scores[ok]))]
        at = _best(*joined, self.k)
        self.rows[item] = tuple(x[at] for x in joined)
        if len(at) == self.k:
            self.floor[item] = max(self.floor[item], int(self.rows[item][2][-1]))

    def frame(self) -> pd.DataFrame:
        n = [len(r[2]) for r in self.rows]
        docs, none, scores = (np.concatenate(x) if x else np.zeros(0) for x in zip(*self.rows))
        return pd.DataFrame({"item_no": np.repeat(np.arange(len(n)), n), "doc": pd.array(docs, dtype="Int64"),
                             "no_id": none.astype(bool), "score": scores})


_ACCUMULATED = _BLOCK + ", a_items binary, a_starts binary, a_ordinals binary, a_sums binary, item_no int, doc long, no_id_ boolean, score long"


def accumulated(index: DataFrame, plan, k: int) -> DataFrame:
    """Term at a time: blocks with their long lists and with accumulators of the
    short ones (item a_items[i]: a_ordinals, a_sums from a_starts[i]); and
    rows without a block that hold the best k accumulators of a task's items."""
    names = [f.split()[0] for f in _ACCUMULATED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Plan = plan.value
        best = Best(p.n_items, k)
        by_term = np.argsort(p.term, kind="stable")
        first = np.searchsorted(p.term[by_term], np.arange(p.n_terms + 1))
        for b in batches:
            for r in b.itertuples(index=False):
                terms, starts, ordinals, tfs = (_ints(x) for x in (r.terms, r.starts, r.ordinals, r.tfs))
                lengths, docs, none = _ints(r.lengths, np.int64), _ints(r.docs, np.int64), _ints(r.no_id, bool)
                size = np.diff(starts)
                owner = np.repeat(terms, size)
                short = p.short[owner]
                part = p.parts(lengths, ordinals[short], tfs[short])
                # Every posting of a short list, once for each item that has its term.
                uses = first[owner[short] + 1] - first[owner[short]]
                slot = by_term[np.repeat(first[owner[short]], uses) + np.arange(uses.sum())
                               - np.repeat(np.cumsum(uses) - uses, uses)]
                key = p.item[slot] * len(docs) + np.repeat(ordinals[short], uses)
                cells, cell = np.unique(key, return_inverse=True)
                sums = np.bincount(cell, weights=p.weight[slot] * np.repeat(part, uses), minlength=len(cells)).astype(np.int64)
                items, at = np.unique(cells // max(len(docs), 1), return_index=True)
                at = np.append(at, len(cells)).astype(np.int32)
                o = (cells % max(len(docs), 1)).astype(np.int32)
                for i, lo, hi in zip(items.tolist(), at[:-1].tolist(), at[1:].tolist()):
                    best.add(i, docs[o[lo:hi]], none[o[lo:hi]], sums[lo:hi])
                long = ~p.short[terms]
                yield pd.DataFrame([[r.block, r.docs, r.no_id, r.lengths, terms[long].tobytes(),
                                     np.append(0, np.cumsum(size[long])).astype(np.int32).tobytes(), ordinals[~short].tobytes(),
                                     tfs[~short].tobytes(), items.astype(np.int32).tobytes(), at.tobytes(), o.tobytes(),
                                     sums.tobytes(), None, None, None, None]], columns=names)
        tops = best.frame().rename(columns={"no_id": "no_id_"})
        for c in names[:12]:
            tops[c] = None
        yield tops[names]

    return index.mapInPandas(run, _ACCUMULATED)


def searched(blocks: DataFrame, plan, floors, k: int) -> DataFrame:
    """Document at a time: (item_no, doc, no_id, score) of each task's best k; and a row of
    item_no -1 whose score is how many ranges were scored, its doc how many there were."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p: Plan = plan.value
        best = Best(p.n_items, k, floors.value)
        long = ~p.short[p.term]
        item, term, weights = p.item[long], p.term[long], p.weight[long]
        lists = np.searchsorted(item, np.arange(p.n_items + 1))
        met = scored = 0
        for b in batches:
            for r in b.itertuples(index=False):
                terms, starts, ordinals, tfs = (_ints(x) for x in (r.terms, r.starts, r.ordinals, r.tfs))
                lengths, docs, none = _ints(r.lengths, np.int64), _ints(r.docs, np.int64), _ints(r.no_id, bool)
                if not len(docs):
                    continue
                part = p.parts(lengths, ordinals, tfs)
                ranges = -(-len(docs) // RANGE_DOCS)
                top = np.zeros((len(terms) + 1, ranges), np.int64)  # the last row: a term that the block lacks
                np.maximum.at(top, (np.repeat(np.arange(len(terms)), np.diff(starts)), ordinals // RANGE_DOCS), part)
                where = np.full(p.n_terms, len(terms))
                where[terms] = np.arange(len(terms))
                a_items, a_starts, a_ordinals, a_sums = (_ints(x, t) for x, t in (
                    (r.a_items, np.int32), (r.a_starts, np.int32), (r.a_ordinals, np.int32), (r.a_sums, np.int64)))
                a_at = dict(zip(a_items.tolist(), zip(a_starts[:-1].tolist(), a_starts[1:].tolist())))
                for i in range(p.n_items):
                    mine = slice(lists[i], lists[i + 1])
                    w, rows = weights[mine], where[term[mine]]
                    bound = w @ top[rows] if len(w) else np.zeros(ranges, np.int64)
                    lo, hi = a_at.get(i, (0, 0))
                    if hi > lo:
                        a_top = np.zeros(ranges, np.int64)
                        np.maximum.at(a_top, a_ordinals[lo:hi] // RANGE_DOCS, a_sums[lo:hi])
                        bound = bound + a_top
                    met += ranges
                    open_ = bound >= best.floor[i]
                    n_open = int(open_.sum())
                    if not n_open:
                        continue
                    scored += n_open
                    score = np.zeros(len(docs), np.int64)
                    if hi > lo:
                        score[a_ordinals[lo:hi]] = a_sums[lo:hi]
                    for x, t in zip(w.tolist(), rows.tolist()):
                        if t < len(terms):
                            at = slice(starts[t], starts[t + 1])
                            o = ordinals[at]
                            if 4 * n_open < ranges:  # skip to the open ranges
                                use = open_[o // RANGE_DOCS]
                                score[o[use]] += x * part[at][use]
                            else:
                                score[o] += x * part[at]
                    if n_open < ranges:
                        score[~np.repeat(open_, RANGE_DOCS)[:len(docs)]] = 0
                    best.add(i, docs, none, score)
        yield best.frame()
        yield pd.DataFrame({"item_no": [-1], "doc": [met], "no_id": [False], "score": [scored]})

    cols = [f.split()[0] for f in _BLOCK.split(", ")] + ["a_items", "a_starts", "a_ordinals", "a_sums"]
    return blocks.select(*cols).mapInPandas(run, "item_no int, doc long, no_id boolean, score long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_no").orderBy(F.desc("score"), "no_id", "doc")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", pass_rows: int = PASS_ROWS,
           ranges: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item.

    Items without terms, or whose terms no document holds, have no rows; items of equal
    id and text are one, of one id with different texts several; a null item id is an id. Null and wordless texts
    count as no document. Repeated documents are ranked each; null ids come last among equal
    scores. Other columns are not read; an empty table on either side gives no rows.
    ``ranges`` takes up (ranges met, ranges scored) of every pass."""
    spark = docs.sparkSession
    terms = stored(item_terms(items, item_col, item_text_col), "item_terms")
    passes = max(1, math.ceil(terms.count() / pass_rows))
    out = [_ranked(docs, terms.filter(F.pmod("item", F.lit(passes)) == n), k, id_col, text_col, ranges)
           for n in range(passes)]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _ranked(docs: DataFrame, terms: DataFrame, k: int, id_col: str, text_col: str, ranges: list | None) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    rows = terms.select("item", "item_id", "term", "q").collect()  # about PASS_ROWS rows at most
    if not rows:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score"))
    numbers = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    keys = {x: i for i, x in enumerate(sorted({r["item"] for r in rows}))}
    names = {keys[r["item"]]: r["item_id"] for r in rows}
    vocabulary = sc.broadcast({t.encode(): i for t, i in numbers.items()})
    index = stored(block_index(docs, vocabulary, id_col, text_col), "blocks")
    dfs, n_docs, n_words = corpus_numbers(index)
    dfs = {r["number"]: r["df"] for r in dfs.collect()}  # a row a query term
    plan = sc.broadcast(Plan([(keys[r["item"]], numbers[r["term"]], r["q"]) for r in rows], dfs, n_docs, n_words,
                             len(keys), len(numbers)))
    blocks = stored(accumulated(index, plan, k), "accumulated")
    tops = _top(blocks.filter("block is null").select("item_no", "doc", F.col("no_id_").alias("no_id"), "score"), k)
    floor = np.zeros(len(keys), np.int64)
    for r in tops.filter(F.col("rank") == k).select("item_no", "score").collect():  # a row an item
        floor[r["item_no"]] = r["score"]
    floors = sc.broadcast(floor)
    found = stored(searched(blocks.filter("block is not null"), plan, floors, k), "found")
    if ranges is not None:
        r = found.filter("item_no = -1").agg(F.sum("doc"), F.sum("score")).first()
        ranges.append((r[0] or 0, r[1] or 0))
    for shared in (vocabulary, plan, floors):
        shared.destroy()
    ids = spark.createDataFrame([(i, x) for i, x in names.items()], f"item_no int, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return (_top(found.filter("item_no >= 0"), k).join(F.broadcast(ids), "item_no")
            .select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "score"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
       coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, up),
b AS MATERIALIZED (SELECT item_id, term, count(*) AS q FROM (SELECT item_id,
       unnest(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark, up)
     GROUP BY ALL),
c AS MATERIALIZED (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_words FROM d WHERE len(w) > 0),
p AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*) AS tf
     FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d)
     WHERE term IN (SELECT term FROM b) GROUP BY ALL),
f AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS wt
     FROM p, c GROUP BY term, n_docs),
s AS (SELECT item_id, rid, doc_id,
       sum(q * wt * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
     FROM p JOIN f USING (term) JOIN b USING (term), c GROUP BY item_id, rid, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank
      FROM s WHERE score > 0)
WHERE rank <= 20
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
SQL = {"op13_ranked_search": OP13_SQL}
