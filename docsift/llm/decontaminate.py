"""Benchmark decontamination over a distributed positional inverted index.

1. Term statistics of the whole corpus for the words that test items use.
2. Every window (phrase) orders its words by corpus frequency; the index
   stores the postings (term, document, position) of the ``PROBES`` rarest
   words of each window, from the whole of every document.
3. Phrase search walks those lists from the rarest: a posting gives the
   offset-adjusted start of a possible occurrence, and each further list
   keeps only starts it confirms.
4. What is left is compared word for word with its document: a row for each
   occurrence, of documents that have any. Other documents' texts are read and
   tokenised twice, for the counts and for the postings, and never shuffled.

A common word is a probe only of windows that hold nothing rarer, so the
lists stay short while every occurrence is found: an occurrence has all of
its window's words, hence its probes. All of it is DataFrame code.

The windows' plan is broadcast only while it is small: ``PLAN_BROADCAST_ROWS``
rows, counted first. Beyond that it joins by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import ascii_lower, stored, table

WINDOW = 10
PROBES = 2
PLAN_BROADCAST_ROWS = 200_000
# Letters A-Z belong to the words here, since they are lower-cased afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words of a text before lower-casing; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    """A-Z lower-cased; the plain function where a word is all ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def words_of(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for null."""
    return F.transform(raw_words(text), lowered)


def document_key(id_col: str, text_col: str) -> Column:
    """The index's document key: repeated rows share it and get equal results.
    Two documents that collide only share candidates, which the comparison
    with each text decides."""
    return F.xxhash64(F.col(id_col), F.col(text_col)).alias("th")


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """items (item_id, text) -> (win, words, item_id): the distinct runs of
    ``width`` consecutive words of each item (the whole item, if shorter)."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    return (w.select("item_id", "words", F.explode(starts).alias("at"))
            .select("item_id", F.slice("words", F.col("at"), F.lit(width)).alias("words"))
            .select(F.xxhash64("words").alias("win"), "words", "item_id").distinct())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose rows were counted and are few."""
    return F.broadcast(df) if rows <= PLAN_BROADCAST_ROWS else df


def scanned(docs: DataFrame, terms: DataFrame, n_terms: int,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, n_words, term_id, pos) from one pass over the whole texts: a row
    for every occurrence of ``terms`` (term, term_id), positions from 0, and in any
    case one for each text's last word, or for its lack of words. That row alone
    has doc and n_words."""
    last = F.coalesce(F.col("pos") == F.col("size") - 1, F.lit(True))
    return (docs.select(F.col(id_col).alias("doc"), document_key(id_col, text_col), raw_words(F.col(text_col)).alias("words"))
            .select("doc", "th", F.size("words").alias("size"), F.posexplode_outer("words").alias("pos", "word"))
            .withColumn("term", lowered(F.col("word")))
            .join(_sized(terms.select("term", "term_id"), n_terms), "term", "left")
            .withColumn("last", last).filter("last or term_id is not null")
            .select(F.when(F.col("last"), F.col("doc")).alias("doc"), "th",
                    F.when(F.col("last"), F.col("size")).alias("n_words"), "term_id", "pos"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index alone: (term_id, th, pos) of every occurrence."""
    return scanned(docs, terms, n_terms, id_col, text_col).filter("term_id is not null").select("term_id", "th", "pos")


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """terms (term) -> (term, cf): occurrences over the corpus (0 if none)."""
    seen = (docs.select(F.explode(raw_words(F.col(text_col))).alias("word"))
            .select(lowered(F.col("word")).alias("term")).join(_sized(terms, n_terms), "term").groupBy("term").agg(F.count("*").alias("cf")))
    return terms.join(seen, "term", "left").select("term", F.coalesce("cf", F.lit(0)).alias("cf"))


def probe_plan(windows: DataFrame, counts: DataFrame, probes: int = PROBES) -> DataFrame:
    """(win, rank, term, term_id, off): each window's rarest words, rarest first.
    A window with a word that the corpus lacks cannot occur and has no plan."""
    w = Window.partitionBy("win").orderBy("cf", "term", "off")
    return (windows.select("win", F.posexplode("words").alias("off", "term"))
            .join(counts, "term")
            .withColumns({"rank": F.row_number().over(w),
                          "least": F.min("cf").over(Window.partitionBy("win"))})
            .filter((F.col("rank") <= probes) & (F.col("least") > 0))
            .select("win", "rank", "term", F.xxhash64("term").alias("term_id"), "off"))


def phrase_starts(index: DataFrame, plan: DataFrame, n_plan: int, probes: int = PROBES) -> DataFrame:
    """(th, start, win): starts confirmed by every probe list, rarest
    list first; each further list is met at its offset-adjusted position."""
    hint = lambda df: _sized(df, n_plan)
    first = plan.filter("rank = 1").select("term_id", "win", "off")
    found = (index.join(hint(first), "term_id")
             .select("th", (F.col("pos") - F.col("off")).alias("start"), "win").filter("start >= 0"))
    for rank in range(2, probes + 1):
        step = plan.filter(F.col("rank") == rank).select("win", "term_id", "off")
        listed = index.join(hint(step.select("term_id").distinct()), "term_id").withColumn("hit", F.lit(True))
        found = (found.join(hint(step), "win", "left")
                 .withColumn("pos", F.col("start") + F.col("off"))
                 .join(listed, ["th", "term_id", "pos"], "left")
                 .filter(F.col("hit") | F.col("off").isNull())  # a window may have fewer words than probes
                 .select("th", "start", "win"))
    return found


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """pairs (pair_id, a, b) of term ids -> (pair_id, th, pos_a, pos_b): occurrences
    of the two words at most ``within`` positions apart, in either order.
    Positions meet by buckets of ``within``, so that a long document's lists
    aren't paired with each other whole."""
    a = index.join(pairs.select("pair_id", F.col("a").alias("term_id"), "b"), "term_id")
    a = a.select("pair_id", "th", F.col("pos").alias("pos_a"), F.col("b").alias("term_id"),
                 F.explode(F.array(*[F.floor(F.col("pos") / within) + d for d in (-1, 0, 1)])).alias("bucket"))
    b = index.select("th", "term_id", F.col("pos").alias("pos_b"),
                     F.floor(F.col("pos") / within).alias("bucket"))
    return (a.join(b, ["th", "term_id", "bucket"])
            .filter((F.abs(F.col("pos_a") - F.col("pos_b")) <= within) & (F.col("pos_a") != F.col("pos_b")))
            .select("pair_id", "th", "pos_a", "pos_b"))


def near_words(docs: DataFrame, pairs: DataFrame, within: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """pairs (pair_id, a, b) of words -> (``id_col``, pair_id, pos_a, pos_b):
    everywhere in the whole texts where the two words are at most ``within``
    positions apart, in either order. The index holds the postings of all the
    pairs' words. Words are compared after lower-casing A-Z; pairs with a null or an
    absent word match nothing; repeated documents give their matches each."""
    low = pairs.select("pair_id", ascii_lower(F.col("a")).alias("a"), ascii_lower(F.col("b")).alias("b"))
    terms = stored(low.select(F.col("a").alias("term")).union(low.select("b")).filter("term is not null").distinct()
                   .withColumn("term_id", F.xxhash64("term")), "terms")
    found = stored(scanned(docs, terms, terms.count(), id_col, text_col), "postings")
    index = found.filter("term_id is not null").select("term_id", "th", "pos").distinct()  # of repeated rows, one
    ids = low.select("pair_id", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).filter("a is not null and b is not null")
    rows = found.filter("n_words is not null").select("th", F.col("doc").alias(id_col))
    return proximity_matches(index, ids, within).join(rows, "th").select(id_col, "pair_id", "pos_a", "pos_b")


def find_phrases(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((th, start, win) that the index confirms, for stored ``windows``;
    (doc, th, n_words) of every row of ``docs``)."""
    terms = stored(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    n_terms = terms.count()
    counts = term_counts(docs, terms, n_terms, id_col, text_col)
    plan = stored(probe_plan(windows, counts), "plan")
    n_plan = plan.count()
    listed = stored(plan.select("term", "term_id").distinct(), "listed")
    found = stored(scanned(docs, listed, n_terms, id_col, text_col), "postings")
    # Repeated rows have one key, and their postings count once.
    index = found.filter("term_id is not null").select("term_id", "th", "pos").distinct()
    return (phrase_starts(index, plan, n_plan).distinct(),
            found.filter("n_words is not null").select("doc", "th", "n_words"))


def confirmed(docs: DataFrame, starts: DataFrame, windows: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc, th, start, len, win): the ``starts`` (th, start, win) at which the
    document's words are the window's, word for word. Only documents with a start
    are read; each occurrence is a row of its own."""
    keys = stored(starts.select("th").distinct(), "candidate_keys")
    texts = (docs.select(F.col(id_col).alias("doc"), document_key(id_col, text_col), F.col(text_col).alias("text"))
             .join(_sized(keys, keys.count()), "th").select("doc", "th", "text").distinct())
    words = stored(texts.select("doc", "th", words_of(F.col("text")).alias("words")), "candidates")
    phrases = windows.select("win", F.size("words").alias("len"), F.array_join("words", " ").alias("phrase"))
    met = starts.join(_sized(phrases, windows.count()), "win").join(words, "th")
    held = F.array_join(F.slice("words", F.col("start") + 1, F.col("len")), " ") == F.col("phrase")
    return met.filter(held).select("doc", "th", "start", "len", "win")


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                   text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc, th, start, len, win) of all occurrences; (win, item_id);
    (doc, th, n_words) of every row of ``docs``)."""
    owned = stored(windows_of(items.filter(F.col("item_id").isNotNull()), width), "owned_windows")
    windows = stored(owned.select("win", "words").distinct(), "windows")
    starts, rows = find_phrases(docs, windows, id_col, text_col)
    found = confirmed(docs, stored(starts, "starts"), windows, id_col, text_col)
    return stored(found, "occurrences"), owned.select("win", "item_id"), rows


def phrase_spans(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(``id_col``, item_id, start, len): every occurrence of every window of
    every item, in words from 0; of repeated rows once."""
    found, owners, _ = phrase_matches(docs, items, width, id_col, text_col)
    return found.join(owners, "win").select(F.col("doc").alias(id_col), "item_id", "start", "len")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, item_ids, contaminated.

    Null or wordless texts have no words and no hits (items_sha256 is that of
    the empty string); items without words, or with a null id, match nothing;
    repeated documents each get their row; an empty table on either side
    gives no hits. Columns other than the id and the text are not read.
    Occurrences stay rows: a passage that many items share is joined to them after
    a document's repeats of it are one row.
    """
    found, owners, rows = phrase_matches(docs, items, width, id_col, text_col)
    before = Window.partitionBy("doc", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    covered = (found.select("doc", "th", "start", "len").distinct()
               .withColumn("upto", F.coalesce(F.max(end).over(before), F.lit(0)))
               .groupBy("doc", "th")
               .agg(F.sum(F.greatest(F.lit(0), end - F.greatest("upto", "start"))).cast("long").alias("n_hit")))
    held = (found.select("doc", "th", "win").distinct().join(owners, "win")
            .groupBy("doc", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    same = lambda a, b: a["th"].eqNullSafe(b["th"]) & a["doc"].eqNullSafe(b["doc"])
    hits = stored(covered.join(held, same(covered, held)).select(covered["doc"], covered["th"], "n_hit", "item_ids"), "hits")
    hits = _sized(hits, hits.count())
    none = F.array().cast(hits.schema["item_ids"].dataType)
    out = (rows.join(hits, same(rows, hits), "left")
           .select(rows["doc"], F.col("n_words").cast("long").alias("n_words"),
                   F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")))
    return out.select(F.col("doc").alias(id_col), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",").cast("binary"),
                             256).alias("items_sha256"),
                      "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


OP4_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id,
       coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
     FROM documents, up),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
     FROM benchmark, up),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS phrase
     FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
     FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT rid, i, n, item_id FROM runs JOIN win USING (n, phrase)),
spot AS (SELECT rid, count(DISTINCT p) AS n_hit
     FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
     FROM (SELECT DISTINCT rid, item_id::VARCHAR AS k FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spot USING (rid) LEFT JOIN its USING (rid)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
SQL = {"op4_decontaminate": OP4_SQL}
