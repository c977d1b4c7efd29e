"""Mixing sources to target weights by capped water-filling.

1. Sources share a budget by weight. A source's target stops at ``max_epochs``
   times its size; what it can't take is shared by weight among the rest, round
   by round, until no target is above its stop. Each round is one aggregate
   over the table of sources; the level that the open sources reach is a
   fraction of whole numbers, so no round depends on rounding.
2. A source's target is so many whole repetitions of it and a fraction. Every
   document is taken whole that often; the fraction is filled from documents in
   a seeded order (a hash of seed, id, source and text), and the one document
   at its end is taken in part.
3. That order needs running sums by source: documents are dealt into 65,536
   hash buckets a source, summed by bucket, and the sums of the buckets before
   are added, so that a source that holds most documents is many groups.

All of it is DataFrame code; nothing of the documents' number reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsift.llm.common import stored, table
from docsift.operators.ids import range_offsets

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PERCENT = 150
MAX_EPOCHS = 2
SEED = "mix"


def sized(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """(doc, source, size, key) of every document: its words, and its place in
    the seeded order. Rows of equal id, source and text share a key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (id_col, source_col)]
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(source_col).alias("source"),
                       F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long").alias("size"),
                       F.md5(F.concat_ws("|", F.lit(seed), *named, text)).alias("key"))


def weighted_sources(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh
    ``weights`` in turn."""
    sizes = (rows.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("last", F.col("source").isNull()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    return (range_offsets(sizes, ["last", "source"], offset_col="nth")
            .select("source", "source_size", weight.cast("long").alias("weight")))


def water_level(sources: DataFrame, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> tuple[int, int]:
    """(num, den): a source's target is the lesser of weight * num / den and
    max_epochs times its size. ``sources`` is read once a round."""
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cap = whole("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    num, den, above = 0, 1, F.lit(False)  # before the first round no source is at its stop
    full_before = -1
    while True:
        r = sources.agg(F.sum(F.when(above, cap)).alias("taken"), F.sum(F.when(~above, F.col("weight"))).alias("open"),
                        F.count(F.when(above, 1)).alias("full")).first()
        if r["full"] == full_before or not r["open"]:
            return num, den
        full_before = r["full"]
        num, den = int(percent * total - 100 * (r["taken"] or 0)), int(100 * r["open"])
        above = whole("weight") * F.lit(Decimal(num)) > cap * F.lit(Decimal(den))


def with_targets(sources: DataFrame, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target, whole, part): repetitions of the
    whole source, and the words to take of one more."""
    num, den = water_level(sources, percent, max_epochs)
    share = (F.col("weight").cast("decimal(38,0)") * F.lit(Decimal(num))).cast("double") / F.lit(float(den))
    cap = (F.col("source_size") * max_epochs).cast("double")
    words = sources.withColumn("target", F.least(share, cap)).withColumn("words", F.round("target").cast("long"))
    return (words.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
            .withColumn("part", F.col("words") - F.col("whole") * F.col("source_size")).drop("words"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS,
          seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    A source's taken words are its target rounded, less at most one word for
    each of the equal rows that end it. Null and empty texts have size 0 and
    nothing taken; a null source is a source of its own, a null id a document;
    rows of equal id, source and text are taken alike; other columns are not
    read; an empty table gives no rows. Reruns, and runs over other partitions, agree."""
    rows = stored(sized(docs, seed, id_col, source_col, text_col), "sized")
    plan = stored(with_targets(stored(weighted_sources(rows, weights), "sources"), percent, max_epochs), "mix_targets")
    groups = stored(rows.groupBy("source", F.substring("key", 1, 4).alias("bucket"), "key", "size")
                    .agg(F.count("*").alias("n")), "mix_groups")
    words = F.col("size") * F.col("n")
    buckets = groups.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
                             F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    placed = (groups.withColumn("at", F.coalesce(F.sum(words).over(within), F.lit(0)))
              .join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
              .join(plan.withColumnRenamed("source", "p_source"), F.col("source").eqNullSafe(F.col("p_source"))))
    extra = F.expr("least(size, greatest(0, (part - start - at) div n))")
    taken = placed.select("key", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))
    return (rows.join(taken, "key")
            .select(F.col("doc").alias(id_col), "size", "source_size", "target", "taken"))


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, source,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
       md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(text, ''))) AS key
     FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::HUGEINT AS source_size,
       ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::HUGEINT AS weight
     FROM d GROUP BY source),
r AS (SELECT weight, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
       sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
     FROM s),
-- The level is the highest of those at which the sources of least size for their weight have stopped.
lv AS MATERIALIZED (SELECT * FROM (SELECT (150 * total - 100 * stopped)::HUGEINT AS num, (100 * open)::HUGEINT AS den
     FROM r, (SELECT sum(source_size) AS total FROM s)) ORDER BY num::DOUBLE / den::DOUBLE DESC LIMIT 1),
t AS MATERIALIZED (SELECT source, source_size, least((weight * num)::DOUBLE / den::DOUBLE, 2.0 * source_size) AS target
     FROM s, lv),
p AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, key, any_value(size) AS size, count(*) AS n FROM d GROUP BY source, key),
o AS (SELECT *, coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY key
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g)
SELECT d.doc_id, d.size, p.source_size::BIGINT AS source_size, p.target AS target,
       (p.whole * d.size + least(d.size, greatest(0,
           (round(p.target)::BIGINT - p.whole * p.source_size::BIGINT - o.before) // o.n)))::BIGINT AS taken
FROM d JOIN o USING (key) JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""

QUERIES = {"op11_mix_sources": op11_mix_sources}
SQL = {"op11_mix_sources": OP11_SQL}
