"""URL filters: a blocked Bloom filter of the listed URLs in canonical form
(host, path prefix) passes possible hits on to an exact hash join.

A URL's canonical keys are (host suffix at a label boundary, path prefix).
The filter is a table of 64-bit blocks: a key's first hash picks the block,
its second sets ``HASHES`` bits in it, so one block lookup answers a probe.
False positives reach the exact join and fall out there, hence the filter's
size changes cost, never results.

Everything is DataFrame code. Only the filter is broadcast; its size is
``2 ** blocks_log2`` rows of 16 bytes, bounded by ``MAX_BLOCKS_LOG2`` (16 MB).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm.common import ascii_lower, table

BITS_PER_KEY = 16
HASHES = 4
MAX_BLOCKS_LOG2 = 20

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased;
    empty for null or without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty as for the host."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _block(host: Column, path: Column, log2: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(1 << log2))


def _mask(host: Column, path: Column) -> Column:
    h = F.xxhash64(path, host, F.lit(1))
    bits = [F.expr("1L")] * HASHES
    return reduce(lambda a, b: a.bitwiseOR(b),
                  [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
                   for i, one in enumerate(bits)])


def build_filter(rules: DataFrame, log2: int) -> DataFrame:
    """rules (host, path) -> (block, word): the non-empty blocks."""
    return (rules.select(_block(F.col("host"), F.col("path"), log2).alias("block"),
                         _mask(F.col("host"), F.col("path")).alias("mask"))
            .groupBy("block").agg(F.bit_or("mask").alias("word")))


def clean_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path); block wins where a rule is listed both ways.
    Rules with a null in any column or without a host are ignored."""
    return (rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna().filter("host <> ''")
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` (host, path,
    verdict): a rule fits its host and all its subdomains where the URL's path
    starts with the rule's path; the longest host + path wins.

    Returns page_id, host, path, rule (null if none fits), verdict (the
    rule's, else ``default``: a filter list only acts on what it lists).
    Null or malformed URLs have empty host and path and get ``default``;
    repeated rows each give a row; other columns of ``pages`` are not read.
    """
    rules = clean_rules(rules)
    n, lengths = rules.agg(F.count("*"), F.collect_set(F.length("path"))).first()
    log2 = min(MAX_BLOCKS_LOG2, max(4, (n * BITS_PER_KEY // 64).bit_length()))
    keyed = (pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
             .withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))}))

    # Canonical keys of a URL: host suffixes x prefixes of the listed lengths.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(k) for k in sorted(lengths)]).cast("array<int>"),
                 lambda k: k <= F.length("path")),
        lambda k: F.substring(F.col("path"), F.lit(1), k))
    keys = (keyed.filter(F.col("host") != "").select("page_id", "url", "path", F.explode(suffixes).alias("r_host"))
            .withColumn("path", F.explode(prefixes)).withColumnRenamed("path", "r_path"))

    possible = (keys.withColumn("block", _block(F.col("r_host"), F.col("r_path"), log2))
                .join(F.broadcast(build_filter(rules, log2)), "block")
                .withColumn("mask", _mask(F.col("r_host"), F.col("r_path")))
                .filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")))
    exact = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    best = (possible.join(exact, ["r_host", "r_path"])
            .select("page_id", "url", F.concat("r_host", "r_path").alias("rule"), "verdict")
            .groupBy("page_id", "url")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
            .withColumnsRenamed({"page_id": "b_page_id", "url": "b_url"}))
    out = keyed.join(best, keyed.page_id.eqNullSafe(best.b_page_id) & keyed.url.eqNullSafe(best.b_url), "left")
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (SELECT row_number() OVER () AS rid, page_id,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
fit AS (SELECT p.*, r_host || r_path AS rule, r_verdict,
          row_number() OVER (PARTITION BY rid ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
        FROM p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""

QUERIES = {"op8_url_filter": op8_url_filter}
SQL = {"op8_url_filter": OP8_SQL}
