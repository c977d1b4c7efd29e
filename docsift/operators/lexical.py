"""Lexical retrieval: BM25 (Okapi) as DataFrame jobs.

Constants are the usual library defaults k1=1.5, b=0.75, epsilon=0.25:
idf = ln(N - df + 0.5) - ln(df + 0.5); a negative idf is replaced by
epsilon times the mean idf over the vocabulary; a query word counts once
per occurrence in the query; passages with no query word get no score.

Index layout: one row per (term, passage) with its precomputed weight, so a
search is one join on ``term`` (query side broadcast after a size check,
postings streamed, never shuffled) and one (query, passage) aggregate with
map-side partial sums. Corpus-wide numbers (N, mean length, mean idf) are
scalar subqueries, evaluated once, not joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsift.functions.arrays import explode_rows, runs
from docsift.functions import text as tx
from docsift.operators import word_lists as wl
from docsift.operators.broadcast import row_count_at_most

K1, B, EPSILON = 1.5, 0.75, 0.25
SCORE_DIGITS = 6


def passages(chunk_table: DataFrame) -> DataFrame:
    """(chunk_id, text) as BM25 sees it."""
    return chunk_table.select("chunk_id", tx.trim_passage(F.col("text")).alias("text"))


def term_lists(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``rows(keep..., toks)`` -> (keep..., dl, terms array<struct<term, tf>>): the words of
    a passage are counted in its own row, so none is shuffled."""
    d = rows.select(*keep, F.sort_array(F.coalesce("toks", F.array().cast("array<string>"))).alias("words"))
    d = d.select(*keep, "words", runs(F.col("words")).alias("at"))
    return d.select(*keep, F.size("words").alias("dl"), F.transform("at", lambda r: F.struct(
        F.element_at("words", r["start"]).alias("term"), r["n"].cast("bigint").alias("tf"))).alias("terms"))


def unique_ids(psg: DataFrame) -> bool:
    """Whether no passage shares its id with another (or lacks one): ids alone are shuffled."""
    return psg.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or chunk_id is null").limit(1).count() == 0


def bm25_postings(psg: DataFrame, unique: bool = False) -> DataFrame:
    """(chunk_id, term, tf, dl). dl rides along (it depends on the
    passage only), so lengths need no join later. ``unique``: the ids were found
    so, and postings stay where their passages are; otherwise passages that share
    an id and a length are counted together."""
    post = wl.postings(wl.count_words(psg))
    if not unique:
        post = post.groupBy("chunk_id", "dl", "term").agg(F.sum("tf").alias("tf")).select("chunk_id", "term", "tf", "dl")
    return post


def bm25_lengths(psg: DataFrame) -> DataFrame:
    """F2 per passage: (chunk_id, dl); row-local."""
    return psg.select("chunk_id", F.size(tx.bm25_tokens(F.col("text"))).cast("bigint").alias("dl"))


def bm25_corpus_stats(psg: DataFrame) -> DataFrame:
    """one row (n_passages, avgdl)."""
    return bm25_lengths(psg).agg(
        F.count(F.lit(1)).alias("n_passages"),
        (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))


def _raw_idf(n, df):
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def bm25_idf(postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) with negative idf replaced by eps * mean idf."""
    n = stats.select("n_passages").scalar()
    dfs = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = dfs.withColumn("raw", _raw_idf(n, F.col("df")))
    mean_idf = raw.select(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * mean_idf)
                      .otherwise(F.col("raw")).alias("idf"))


def bm25_weights(with_df: DataFrame, n: float, avgdl: float, mean_idf: float) -> DataFrame:
    """(term, chunk_id, tf, df, w) from postings carrying df."""
    raw = _raw_idf(F.lit(float(n)), F.col("df"))
    idf = F.when(raw < 0, F.lit(EPSILON * mean_idf)).otherwise(raw)
    tf = F.col("tf").cast("double")
    norm = tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl)))
    return with_df.select("term", "chunk_id", "tf", "df", (idf * tf * F.lit(K1 + 1) / norm).alias("w"))


def bm25_index(psg: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, df, w): the BM25 index as one lazy plan. df is a
    partial aggregate joined back on term; corpus numbers are scalar
    subqueries."""
    post = bm25_postings(psg)
    stats = bm25_corpus_stats(psg)
    n = stats.select("n_passages").scalar()
    avgdl = stats.select("avgdl").scalar()
    dfs = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    with_df = post.join(dfs, "term")
    mean_idf = dfs.select(F.avg(_raw_idf(n, F.col("df")))).scalar()
    raw = _raw_idf(n, F.col("df"))
    idf = F.when(raw < 0, F.lit(EPSILON) * mean_idf).otherwise(raw)
    tf = F.col("tf").cast("double")
    norm = tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / avgdl)
    return with_df.select("term", "chunk_id", "tf", "df",
                          (idf * tf * F.lit(K1 + 1) / norm).alias("w"))


POSTINGS_PER_BUCKET = 2_000_000
POSTINGS_PER_FILE = 1_000_000
MAX_TERM_BUCKETS = 4096
MAX_BROADCAST_TERMS = 1_000_000


def term_bucket(term, n_buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(n_buckets)).cast("int")


def write_index(postings: DataFrame, path: str, n_postings: int, dfs: DataFrame,
                weigh: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """Postings written partitioned by term bucket ``tb``; a search reads only
    the buckets of its words. Each bucket is split into files by a salt
    sized from the bucket's row count (the sum of its terms' df), so a bucket
    holding a third of all postings is still written by many tasks. Files
    are sorted by term, so a pushed term filter skips row groups. ``weigh`` makes
    the rows to write of postings with their df; both are added behind the
    shuffle, which so moves words and whole numbers only."""
    n_tb, tb, sizes = _buckets(n_postings, dfs)

    def dealt(d: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("chunk_id"), F.col("n_salt")).cast("int")
        return (d.withColumn("tb", tb).join(F.broadcast(sizes), "tb")  # n_tb rows: bounded by MAX_TERM_BUCKETS
                .withColumn("salt", salt).drop("n_salt").repartition("tb", "salt").drop("salt"))
    if row_count_at_most(dfs, MAX_BROADCAST_TERMS) <= MAX_BROADCAST_TERMS:
        w = weigh(dealt(postings).join(F.broadcast(dfs), "term"))
    else:  # postings meet their df by an equi-join on term; AQE splits the skewed partition of a hot term
        w = dealt(weigh(postings.join(dfs, "term")))
    _store(w.withColumn("tb", tb).sortWithinPartitions("tb", "term", "chunk_id"), path)
    return postings.sparkSession.read.parquet(path), n_tb


def write_inverted(lists: DataFrame, known, path: str, n_postings: int, dfs: DataFrame,
                   weigh: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``write_index`` from passages' word lists: a word and its passages of a batch
    are one row with the df, which is dealt and sorted; postings become rows and get
    their weights behind that."""
    n_tb, tb, sizes = _buckets(n_postings, dfs)
    first, last, longest = (n or 0 for n in lists.agg(F.min("chunk_id"), F.max("chunk_id"), F.max("dl")).first())
    salt = F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("n_salt")).cast("int")
    rows = (wl.inverted(lists, known, first, last, longest).withColumn("tb", tb).join(F.broadcast(sizes), "tb")  # n_tb rows: bounded by MAX_TERM_BUCKETS
            .withColumn("salt", salt).drop("n_salt")
            .repartition(max(1, math.ceil(n_postings / POSTINGS_PER_FILE)), "tb", "salt")
            .sortWithinPartitions("tb", "term", F.element_at("ids", 1)))
    w = weigh(wl.inverted_postings(rows, ["term", "df"], first, lists.schema["chunk_id"].dataType.simpleString()))
    _store(w.withColumn("tb", tb), path)
    return lists.sparkSession.read.parquet(path), n_tb


def _buckets(n_postings: int, dfs: DataFrame) -> tuple[int, Column, DataFrame]:
    """The number of term buckets, a term's bucket and each bucket's number of files."""
    n_tb = int(max(1, min(MAX_TERM_BUCKETS, math.ceil(n_postings / POSTINGS_PER_BUCKET))))
    tb = term_bucket(F.col("term"), n_tb)
    sizes = (dfs.groupBy(tb.alias("tb")).agg(F.sum("df").alias("n"))
             .select("tb", F.greatest(F.lit(1), F.ceil(F.col("n") / POSTINGS_PER_FILE)).cast("int").alias("n_salt")))
    return n_tb, tb, sizes


def _store(w: DataFrame, path: str) -> None:
    from docsift.session import ROW_GROUP_BYTES
    (w.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("compression", "zstd").partitionBy("tb").parquet(path))


def bm25_build(psg: DataFrame, materialize, path: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Offline build used by searches: passages' words are counted and materialised
    once (the tokeniser runs once), corpus numbers are one-row aggregates read as
    literals, the index (partitioned by term bucket) and the idf table are
    written. Returns (index, idf(term, df, idf), stats); beside the numbers, stats has the
    ``postings``, the stored ``lists`` of ``count_words`` (None where passages share ids) and
    the ``known`` words (None there and where they are too many to broadcast)."""
    from docsift.session import scratch_path
    path = path or scratch_path(psg.sparkSession, "bm25")
    unique = unique_ids(psg)
    if unique:
        lists = materialize(wl.count_words(psg))
        n, n_post, total = lists.agg(F.count(F.lit(1)), F.sum(F.size("tfs")), F.sum("dl")).first()
        n_post, total = n_post or 0, total or 0
        post, words = wl.postings(lists), lists.select(F.explode_outer("terms").alias("term")).filter("term is not null")
    else:
        lists = None
        post = words = materialize(bm25_postings(psg))
        n, n_post, total = psg.count(), post.count(), post.agg(F.sum("tf")).first()[0] or 0
    avgdl = (total / n) if n else 0.0
    # df by a partial (map-side combined) aggregate: a term found in a third
    # of all passages is pre-counted in every task, never gathered in one
    dfs = materialize(words.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    mean_idf = dfs.select(F.avg(_raw_idf(F.lit(float(n)), F.col("df")))).first()[0] or 0.0
    raw = _raw_idf(F.lit(float(n)), F.col("df"))
    # a projection of the stored df table: nothing to recompute
    idf = dfs.select("term", "df", F.when(raw < 0, F.lit(EPSILON * mean_idf)).otherwise(raw).alias("idf"))
    known = wl.known_words(dfs) if unique else None
    weigh = lambda with_df: bm25_weights(with_df, n, avgdl, mean_idf)
    if known is not None:
        index, n_tb = write_inverted(lists, known, path, n_post, dfs, weigh)
    else:
        index, n_tb = write_index(post, path, n_post, dfs, weigh)
    return index, idf, {"n_passages": n, "avgdl": avgdl, "mean_idf": mean_idf, "n_postings": n_post,
                        "term_buckets": n_tb, "postings": post, "lists": lists, "known": known}


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, term, qn): query words with their multiplicity."""
    return (explode_rows(queries, ["query_id"], tx.bm25_tokens(F.col(text_col)), "term")
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn")))


def bm25_scores(queries: DataFrame, index: DataFrame, text_col: str = "text",
                term_buckets: int | None = None, best: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) for passages sharing a word with the
    query. The query side is small per batch: broadcast after a size check,
    so the postings are scanned in place and only matching rows move. With
    a bucketed index only the buckets of the batch's words are read (the
    bucket list is bounded by the bucket count). ``best``: scores that can't be among
    a query's ``best`` highest may be missing."""
    qt = query_terms(queries, text_col)
    if term_buckets and "tb" in index.columns:
        # one job: the size check and the bucket list (at most term_buckets values)
        got = qt.agg(F.count(F.lit(1)).alias("n"),
                     F.collect_set(term_bucket(F.col("term"), term_buckets)).alias("tbs")).first()
        index = index.filter(F.col("tb").isin(list(got["tbs"] or [])))
        few = got["n"] <= MAX_BROADCAST_TERMS
    else:
        few = row_count_at_most(qt, MAX_BROADCAST_TERMS) <= MAX_BROADCAST_TERMS
    return best_chunk_scores(index, qt, best) if few and best else query_chunk_scores(index, qt, few)


def query_chunk_scores(weights: DataFrame, qt: DataFrame, few: bool) -> DataFrame:
    """(query_id, chunk_id, score) of ``weights(term, chunk_id, w)`` for ``qt(query_id, term, qn)``.
    Weights of words that some query has are dealt by passage before they meet the queries: a
    posting moves once, however many queries ask for its word, and a passage's sums for all
    queries are made where it lies. A passage has as many postings as words, so none is hot.
    ``few``: ``qt`` was counted small enough to broadcast."""
    if not few:  # a query table of any size: everything meets by word
        return (weights.join(qt, "term").groupBy("query_id", "chunk_id")
                .agg(F.sum(F.col("qn") * F.col("w")).alias("score")))
    asked = weights.join(F.broadcast(qt.select("term").distinct()), "term", "left_semi").select("term", "chunk_id", "w")
    return (asked.repartition("chunk_id").join(F.broadcast(qt), "term").groupBy("query_id", "chunk_id")
            .agg(F.sum(F.col("qn") * F.col("w")).alias("score")))


TIE = 1.1 * 10.0 ** -SCORE_DIGITS  # scores as near as this may be equal once rounded
SLAB_POSTINGS = 1 << 20


def best_chunk_scores(weights: DataFrame, qt: DataFrame, best: int) -> DataFrame:
    """``query_chunk_scores`` of queries counted few, without scores that can't be among the
    ``best`` highest of their query. Postings of asked words are dealt by passage; a kernel adds
    them up, query by query, for a slab of whole passages at a time, so no (query, word, passage)
    is a row, and what leaves a task is about ``best`` rows a query."""
    spark = weights.sparkSession
    got = qt.select("query_id", "term", "qn").toArrow().combine_chunks()  # at most MAX_BROADCAST_TERMS rows
    schema = f"query_id {qt.schema['query_id'].dataType.simpleString()}, chunk_id {weights.schema['chunk_id'].dataType.simpleString()}, score double"
    if not got.num_rows:
        return spark.createDataFrame([], schema)
    ids, terms = (got[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
    query = ids.indices.to_numpy()
    order = np.argsort(query, kind="stable")
    ends = np.bincount(query).cumsum()
    shared = spark.sparkContext.broadcast((ids.dictionary, ends, terms.indices.to_numpy()[order], got["qn"].to_numpy()[order], len(terms.dictionary)))
    codes = spark.createDataFrame(pa.table({"term": terms.dictionary, "code": pa.array(np.arange(len(terms.dictionary)), pa.int32())}))
    asked = (weights.select("term", "chunk_id", "w").join(F.broadcast(codes), "term").select("code", "chunk_id", "w")
             .repartition("chunk_id"))
    return asked.mapInArrow(_best_scores(shared, best), schema)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code, chunk_id, w) of a partition, cut between passages into slabs of about SLAB_POSTINGS."""
    held = [[b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("code", "chunk_id", "w")] for b in batches if b.num_rows]
    if not held:
        return
    code, chunk, w = (np.concatenate(x) for x in zip(*held))
    del held
    order = np.argsort(chunk, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0))
    cuts = first[np.unique(np.searchsorted(first, np.arange(0, len(order), SLAB_POSTINGS)).clip(max=len(first) - 1))]
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        mine = order[a:b]
        yield code[mine], chunk[mine], w[mine]


def _best_scores(shared, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, words, times, n_words = shared.value
        floor = np.full(len(ends), -np.inf)
        for code, chunk, w in _slabs(batches):
            chunks, place = np.unique(chunk, return_inverse=True)
            cell = code.astype(np.int64) * len(chunks) + place
            order = np.argsort(cell, kind="stable")
            cell, w = cell[order], w[order]
            at = np.searchsorted(cell, np.arange(n_words + 1) * len(chunks))
            place = cell % len(chunks)
            out = []
            for q, end in enumerate(ends):
                mine = slice(ends[q - 1] if q else 0, end)
                parts = [(at[c], at[c + 1], n) for c, n in zip(words[mine].tolist(), times[mine].tolist()) if at[c] < at[c + 1]]
                if not parts:
                    continue
                where = np.concatenate([place[a:b] for a, b, _ in parts])
                score = np.bincount(where, np.concatenate([w[a:b] * n for a, b, n in parts]), len(chunks))
                has = np.zeros(len(chunks), bool)
                has[where] = True
                hit = np.flatnonzero(has & (score >= floor[q] - TIE))
                value = score[hit]
                if len(hit) > best:
                    floor[q] = max(floor[q], np.partition(value, len(hit) - best)[len(hit) - best])
                    hit = hit[value >= floor[q] - TIE]
                    by = hit[np.lexsort((hit, -score[hit]))]  # of equal scores, those of the smallest ids
                    new = np.flatnonzero(np.append(True, np.diff(score[by]) != 0))
                    hit = by[np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by)))) < best]
                out.append((np.full(len(hit), q), hit, score[hit]))
            if out:
                q, hit, score = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(chunks[hit]), pa.array(score)], ["query_id", "chunk_id", "score"])
    return fn


def top_k(scores: DataFrame, k: int, score_col: str = "score", id_col: str = "chunk_id",
          ascending: bool = False) -> DataFrame:
    """Top k per query by the rounded score (ties: smaller id); Spark plans a
    partial WindowGroupLimit so only k rows per query leave each task."""
    key = F.round(score_col, SCORE_DIGITS)
    order = key.asc() if ascending else key.desc()
    w = Window.partitionBy("query_id").orderBy(order, F.col(id_col).asc())
    return (scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn(score_col, F.round(score_col, SCORE_DIGITS)))


def bm25_top(queries: DataFrame, chunk_table: DataFrame, k: int,
             index: DataFrame | None = None) -> DataFrame:
    """F5 (k=5): (query_id, rank, chunk_id, score)."""
    index = bm25_index(passages(chunk_table)) if index is None else index
    return top_k(bm25_scores(queries, index), k).select("query_id", "rank", "chunk_id", "score")
