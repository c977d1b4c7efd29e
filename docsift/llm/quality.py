"""Quality classifier: a sparse ensemble of rules.

Statistics of the whole text (``text_statistics``) feed shallow trees; every
path from a root is a conjunctive rule over statistics; a lasso logistic
regression gives most rules no weight; the rest are compiled into one Spark
column expression. Trees and weights are fitted by Spark ML on a sample of at
most ``TRAIN_ROWS`` labelled rows (those whose id hashes lowest); every
document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import held_out, stored, table, training_row, worker_memo

TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
LASSO = 0.002
SEED = 17

STATISTICS = ["bytes_log2", "words_log2", "upper", "digits", "symbols", "stops", "exclaims", "bars", "quotes",
              "wide", "spaces", "word_bytes", "distinct", "top_word", "line_words", "repeated_lines",
              "plain_words", "ended_lines", "longest_word"]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#$%&*@^~<>{}[]\\=_+`/"
_STOPS = b".,;:?"
_WIDE = bytes(range(128, 256))


def _statistics(text: str | None) -> tuple:
    b = (text or "").encode()
    size, words, lines = len(b), b.split(), [x for x in b.split(b"\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    share = lambda of: (size - len(b.translate(None, of))) / max(size, 1)
    counts = Counter(words)
    letters = share(_LETTERS)
    return (float(size.bit_length()), float(len(words).bit_length()), share(_UPPER) / max(letters, 1e-9), share(_DIGITS),
            share(_SYMBOLS), share(_STOPS), b.count(b"!") / n, b.count(b"|") / n, b.count(b'"') / n,
            share(_WIDE), share(b" \t\r\n\f\v"), sum(map(len, words)) / n, len(counts) / n,
            max(counts.values(), default=0) / n, len(words) / m, 1 - len(set(lines)) / m,
            sum(map(bytes.isalpha, words)) / n, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
            float(max(map(len, words), default=0)))


def text_statistics(text: Column) -> Column:
    """A struct of ``STATISTICS`` (doubles) of each whole text; null and empty
    texts have zeros."""
    schema = ", ".join(f"{s} double" for s in STATISTICS)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_memo(None)
        for b in batches:
            yield pd.DataFrame([_statistics(t) for t in b], columns=STATISTICS, dtype="float64")

    return run(text)


def tree_rules(debug: str) -> list[tuple[tuple[int, str, float], ...]]:
    """The paths to every node of the trees in a Spark ML forest's description,
    as sets of conditions (statistic, ``<=`` or ``>``, bound), one condition for each
    statistic and direction; without doubles, in order of appearance."""
    out: dict[tuple, None] = {}
    path: list[tuple[int, tuple[int, str, float]]] = []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3], float(m[4])))]
            bounds: dict[tuple[int, str], float] = {}
            for _, (f, op, x) in path:
                bounds[f, op] = (min if op == "<=" else max)(bounds.get((f, op), x), x)
            out[tuple(sorted((f, op, x) for (f, op), x in bounds.items()))] = None
        elif line.lstrip().startswith("Tree"):
            path = []
    return list(out)


def rule_column(rule: tuple[tuple[int, str, float], ...], names: list[str]) -> Column:
    """A rule as a Spark condition over columns ``names``."""
    return reduce(lambda a, b: a & b, [F.col(names[f]) <= x if op == "<=" else F.col(names[f]) > x for f, op, x in rule])


class RuleEnsemble:
    """Weighted rules: score = logistic(intercept + weights of the rules that hold)."""

    def __init__(self, intercept: float, weighted: list[tuple[tuple, float]], names: list[str] = STATISTICS):
        self.intercept, self.weighted, self.names = intercept, weighted, names

    def score(self) -> Column:
        """The compiled ensemble over columns named as the statistics."""
        margin = F.lit(float(self.intercept))
        for rule, weight in self.weighted:
            margin = margin + F.when(rule_column(rule, self.names), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def described(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[f]} {op} {x:g}" for f, op, x in r)
                for r, w in sorted(self.weighted, key=lambda p: -abs(p[1]))]


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(label, statistics) of at most ``rows`` labelled documents that models
    may learn from. Null labels are left out."""
    ids = (labels.filter(F.col("quality").isNotNull() & training_row(F.col("doc_id")))
           .select("doc_id", F.col("quality").cast("double").alias("label")).distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows))
    found = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
             .select("doc_id", "label", text_statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*"))
    return stored(found.repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id", "label", *STATISTICS), "sample")


def fit_rules(sample: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Fit on (label, statistics). Without rows the score is 0.5; with one
    label alone it is that label's smoothed share."""
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        import math
        ones, n = counts.get(1.0, 0), sum(counts.values())
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    total = sum(counts.values())
    weighted = sample.withColumn("w", F.when(F.col("label") == 1, total / 2 / counts[1.0]).otherwise(total / 2 / counts[0.0]))
    grown = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth,
                                   featureSubsetStrategy="onethird", minInstancesPerNode=max(2, total // 1000), seed=SEED)
    forest = grown.fit(VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(weighted))
    rules = tree_rules(forest.toDebugString)
    holds = [F.when(rule_column(r, STATISTICS), 1.0).otherwise(0.0) for r in rules]
    share = sample.select(*[F.avg(h).alias(f"r{i}") for i, h in enumerate(holds)]).first()
    kept = [i for i in range(len(rules)) if 0 < share[i] < 1]  # the lasso chooses; these say nothing
    if not kept:
        import math
        return RuleEnsemble(math.log(counts[1.0] / counts[0.0]), [])
    x = stored(sample.select("label", F.array(*[holds[i] for i in kept]).alias("holds")), "rules")
    fit = LogisticRegression(featuresCol="x", labelCol="label", regParam=lasso, elasticNetParam=1.0, maxIter=200).fit(
        x.select("label", array_to_vector("holds").alias("x")))
    weights = fit.coefficients.toArray()
    return RuleEnsemble(fit.intercept, [(rules[i], w) for i, w in zip(kept, weights) if abs(w) > 1e-9])


def train(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    return fit_rules(training_sample(docs, labels))


def scored(docs: DataFrame, ensemble: RuleEnsemble, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row of ``docs``, score and predicted. Null
    and empty texts are scored by their zero statistics; repeated rows get
    equal scores; only ``keep`` and the text are read."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    out = docs.select(*kept, text_statistics(F.col(text_col)).alias("s")).select(
        *[f"k{i}" for i in range(len(keep))], "s.*").withColumn("score", ensemble.score())
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return (scored(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"))


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
