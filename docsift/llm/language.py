"""Language identification: known words first, then shorter and shorter
character n-grams.

A word (a run of letters, lower-cased) that the model knows counts with its
smoothed log frequency in each language, or a floor common to all languages. Any other word counts with its longest known
n-grams: those of ``LONGEST`` characters (word borders marked), failing that of
one character fewer, and so on. A text's language has the largest mean over
its words; the score is its share under a softmax of evidence that grows with
the square root of the words, since words of a text are not independent.

The model is learnt by Spark from about ``TRAIN_DOCS`` documents of each
language (those whose id hashes low); its tables have at most ``WORDS`` words
and ``GRAMS`` n-grams of each length for each language, so their size is
bounded, and they go to the tasks as a broadcast. Every whole text is scored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import held_out, stored, table, training_row, worker_memo

TRAIN_DOCS = 2000
WORDS = 20_000
GRAMS = 20_000
LONGEST = 5
MIN_WORD = 3
SMOOTHING = 0.5
MEMO_WORDS = 400_000
UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")


class Evidence:
    """Log frequencies of keys by language: a row each in one matrix, which takes a
    tenth of an array for each key."""

    def __init__(self, rows: dict[str, int], values: np.ndarray):
        self.rows, self.values = rows, values

    @staticmethod
    def of(table: Evidence | dict[str, np.ndarray], langs: list[str]) -> Evidence:
        if isinstance(table, Evidence):
            return table
        values = np.array(list(table.values()), dtype="float32").reshape(len(table), len(langs))
        return Evidence({k: i for i, k in enumerate(table)}, values)


class BackoffModel:
    """Log frequencies by language: ``words`` and, by length, ``grams``."""

    def __init__(self, langs: list[str], words: Evidence | dict[str, np.ndarray], grams: dict[int, Evidence | dict[str, np.ndarray]]):
        self.langs, self.words, self.grams = langs, Evidence.of(words, langs), {n: Evidence.of(g, langs) for n, g in grams.items()}

    def word(self, w: str) -> np.ndarray | None:
        """The evidence of one word; None without letters."""
        known = self.words.rows.get(w)
        if known is not None:
            return self.words.values[known]
        if not any(map(str.isalpha, w)):
            return None
        marked = f"<{w}>"
        for n in range(LONGEST, 0, -1):
            table = self.grams.get(n)
            if table is None:
                continue
            found = [g for i in range(len(marked) - n + 1) if (g := table.rows.get(marked[i:i + n])) is not None]
            if found:
                return np.mean(table.values[found], axis=0)
        return np.zeros(len(self.langs), dtype="float32")


class Scorer:
    """A model with the evidence of words seen before, one row each. Row 0 is
    for words without letters."""

    def __init__(self, model: BackoffModel):
        self.model = model
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), dtype="float32")
        self.used = 1

    def _row(self, w: str) -> int:
        e = self.model.word(w)
        if e is None:
            self.rows[w] = 0
            return 0
        if self.used == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.used] = e
        self.rows[w] = self.used
        self.used += 1
        return self.used - 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        model, rows = self.model, self.rows
        words = _RUN.findall((text or "").lower())
        if len(rows) > MEMO_WORDS:
            rows.clear()
            self.used = 1
        idx = np.array([i if (i := rows.get(w)) is not None else self._row(w) for w in words], dtype=np.int64)
        idx = idx[idx > 0]
        if not len(idx) or not model.langs:
            return UNDETERMINED, 0.0
        # Large texts add up in double precision, language by language.
        mean = self.table[idx].sum(axis=0, dtype="float64") / len(idx)
        x = (mean - mean.max()) * math.sqrt(len(idx))
        p = np.exp(x)
        best = int(np.argmax(p))  # ties: the first language in order
        return model.langs[best], float(p[best] / p.sum())


def _log_table(counts: DataFrame, key: str, keep: int, langs: list[str], least: int = 1) -> Evidence:
    """counts (lang, key, n) -> key to log frequencies by language, of each
    language's ``keep`` most frequent keys that it has ``least`` times. Totals
    and frequencies are those of all ``counts``. What a language has not seen
    gets one floor, the same for all: that of the largest one, under every
    frequency. The driver gets at most ``keep`` rows for each language
    and language pair."""
    top = (counts.filter(F.col("n") >= least)
           .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key)))
           .filter(F.col("k") <= keep).select(key).distinct())
    got = counts.join(top, key).select("lang", key, "n").toArrow()  # columns: a row object for each would take many times that
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    keys = got[key].combine_chunks().dictionary_encode()
    rows = {k: i for i, k in enumerate(keys.dictionary.to_pylist())}
    spread = SMOOTHING * len(rows)
    floor = math.log(SMOOTHING / (max(totals.values(), default=0) + spread)) if rows else 0.0
    values = np.full((len(rows), len(langs)), floor, dtype="float32")
    place = {x: i for i, x in enumerate(langs)}
    for i, lang, n in zip(keys.indices.to_pylist(), got["lang"].to_pylist(), got["n"].to_pylist()):
        values[i, place[lang]] = math.log((n + SMOOTHING) / (totals[lang] + spread))
    return Evidence(rows, values)


def learn(docs: DataFrame, rows_per_language: int = TRAIN_DOCS) -> BackoffModel:
    """Learn from the text and non-null lang of rows that models may learn
    from. A corpus without such rows gives a model that determines nothing."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & training_row(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return BackoffModel([], {}, {})
    scale = 1 << 20
    part = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(scale, rows_per_language * scale // n + 1))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < part[F.col("lang")])
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    counts = stored(sample.select("lang", word.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    langs = sorted(sizes)
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = {}
    for n in range(LONGEST, 0, -1):
        g = F.explode(F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, F.lit(n))))
        by = (counts.filter(F.length(marked) >= n).select("lang", g.alias("gram"), "n")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        grams[n] = _log_table(by, "gram", GRAMS, langs)
    words = _log_table(counts, "word", WORDS, langs, MIN_WORD)
    return BackoffModel(langs, words, grams)


def predicted(text: Column, model: BackoffModel, spark: SparkSession) -> Column:
    """A struct (lang_pred, score) of each whole text: ``und`` and 0 for null
    texts and texts without letters."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        scorer = Scorer(shared.value)
        for b in batches:
            yield pd.DataFrame([scorer(t) for t in b], columns=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, model: BackoffModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row of ``docs``, lang_pred and score. Repeated
    rows get equal results; only ``keep`` and the text are read."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    out = docs.select(*kept, predicted(F.col(text_col), model, docs.sparkSession).alias("p"))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "p.lang_pred", "p.score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (identify(docs, learn(docs), ["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
