"""A BM25 index that grows: immutable segments, tombstones, tiered merges.

A segment holds the passages of one addition: its postings (term, passage,
tf, length; no weights), its passages with their terms, and its term and
passage counts. A deletion writes what the passages it removes counted,
segment by segment. idf and the mean length are sums over the live segments
at query time, all of whole numbers, so a search gives exactly what an
index rebuilt from the live passages would.

The manifest names the live segments and deletions; a new version of it is written last,
so a reader keeps the version that it opened, and a failed change leaves the index as it
was. There is one writer at a time.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.functions import text as tx
from docsift.functions.arrays import explode_rows
from docsift.operators import lexical as lx
from docsift.operators.broadcast import broadcast_if_small

TERM_BUCKETS = 64
ID_BUCKETS = 64
MERGE_FACTOR = 4
ROWS_PER_FILE = 1_000_000

_MANIFEST = "version long, segments array<string>, deletions array<string>, fingerprint decimal(38,0)"


def fingerprint(passages: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> int:
    """One number for a table's ids and texts, in any order: equal tables have equal ones."""
    mark = F.xxhash64(id_col, text_col).cast("decimal(38,0)")
    return int(passages.agg(F.sum(mark)).first()[0] or 0)


class SegmentedIndex:
    """The index under ``path``, at the version that was opened."""

    def __init__(self, spark: SparkSession, path: str, version: int, segments: Sequence[str], deletions: Sequence[str],
                 mark: int):
        self.spark, self.path, self.version = spark, path, version
        self.segments, self.deletions, self.fingerprint = list(segments), list(deletions), mark
        self._mean_idf: float | None = None

    # ------------------------------------------------------------ versions
    @staticmethod
    def create(spark: SparkSession, path: str) -> "SegmentedIndex":
        return SegmentedIndex(spark, path, 0, [], [], 0)._commit()

    @staticmethod
    def open(spark: SparkSession, path: str) -> "SegmentedIndex":
        r = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
        return SegmentedIndex(spark, path, r["version"], r["segments"], r["deletions"], int(r["fingerprint"]))

    def _commit(self) -> "SegmentedIndex":
        from decimal import Decimal
        row = [(self.version, self.segments, self.deletions, Decimal(self.fingerprint))]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self

    def _next(self, segments: list[str], deletions: list[str], mark: int) -> "SegmentedIndex":
        return SegmentedIndex(self.spark, self.path, self.version + 1, segments, deletions, mark)._commit()

    def is_current(self, passages: DataFrame) -> bool:
        """Whether the index holds just these passages (chunk_id, text)."""
        return fingerprint(passages) == self.fingerprint

    # --------------------------------------------------------------- parts
    def _part(self, kind: str, names: Sequence[str], schema: str) -> DataFrame:
        """The rows of one kind of table over parts, with the part's name."""
        out = self.spark.createDataFrame([], schema + ", part string")
        for name in names:
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{kind}")
                                  .withColumn("part", F.lit(name)))
        return out

    def _live(self, kind: str, schema: str) -> DataFrame:
        """Rows (seg, ...) of deletions that concern live segments."""
        return self._part(kind, self.deletions, schema).filter(F.col("seg").isin(self.segments)).drop("part")

    def _write_segment(self, passages: DataFrame, name: str) -> None:
        """passages(chunk_id, dl, mark, terms array<struct<term, tf>>), stored."""
        root = f"{self.path}/{name}"
        files = max(1, math.ceil(passages.count() / ROWS_PER_FILE))
        placed = passages.withColumn("ib", F.pmod(F.xxhash64("chunk_id"), F.lit(ID_BUCKETS)).cast("int"))
        salt = F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(files))
        placed.repartition("ib", salt).write.partitionBy("ib").parquet(f"{root}/passages")
        post = (passages.select("chunk_id", "dl", F.explode("terms").alias("t"))
                .select(F.col("t.term").alias("term"), "chunk_id", F.col("t.tf").alias("tf"), "dl"))
        # a term's postings go to as many files as its segment has rows for
        (post.withColumn("tb", lx.term_bucket(F.col("term"), TERM_BUCKETS)).repartition("tb", salt)
         .sortWithinPartitions("tb", "term", "chunk_id").write.partitionBy("tb").parquet(f"{root}/postings"))
        post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{root}/terms")
        passages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("len")).write.parquet(f"{root}/numbers")

    _PASSAGES = "chunk_id long, dl int, mark long, terms array<struct<term:string,tf:bigint>>, ib int"

    def passages(self) -> DataFrame:
        """Live passages: (chunk_id, dl, mark, terms, part)."""
        gone = self._live("ids", "seg string, chunk_id long")
        return (self._part("passages", self.segments, self._PASSAGES)
                .join(gone.withColumnRenamed("seg", "part"), ["part", "chunk_id"], "left_anti"))

    # ------------------------------------------------------------- changes
    def add(self, passages: DataFrame) -> "SegmentedIndex":
        """passages(chunk_id, text), of ids that the index doesn't hold (``update``
        replaces): one new segment; nothing else is read or written."""
        from docsift.session import cut_lineage
        toks = passages.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.xxhash64("chunk_id", "text").alias("mark"),
                               tx.bm25_tokens(tx.trim_passage(F.col("text"))).alias("toks"))
        lists = lx.term_lists(toks.withColumn("size", F.size("toks")), ["chunk_id", "mark", "size"])
        if not lx.unique_ids(toks):  # passages of one id have all its words
            none = F.array().cast("array<struct<term:string,tf:bigint>>")
            terms = (explode_rows(lists, ["chunk_id"], F.col("terms"), "t").groupBy("chunk_id", F.col("t.term").alias("term"))
                     .agg(F.sum("t.tf").alias("tf")).groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms")))
            lists = lists.drop("terms").join(terms, "chunk_id", "left").withColumn("terms", F.coalesce("terms", none))
        rows = cut_lineage(lists.select("chunk_id", F.col("size").alias("dl"), "mark", "terms"), "segment")
        name = f"seg-{os.urandom(6).hex()}"
        self._write_segment(rows, name)
        added = int(rows.agg(F.sum(F.col("mark").cast("decimal(38,0)"))).first()[0] or 0)
        return self._next([*self.segments, name], self.deletions, self.fingerprint + added)

    def delete(self, ids: DataFrame) -> "SegmentedIndex":
        """Remove the passages of ``ids`` (chunk_id); others are not touched. Ids that
        the index lacks, nulls and repeats change nothing."""
        from docsift.session import cut_lineage
        gone = cut_lineage(self.passages().join(ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct(),
                                                "chunk_id", "left_semi").withColumnRenamed("part", "seg"), "deleted")
        name = f"del-{os.urandom(6).hex()}"
        gone.select("seg", "chunk_id").write.parquet(f"{self.path}/{name}/ids")
        (gone.select("seg", F.explode("terms.term").alias("term")).groupBy("seg", "term")
         .agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{self.path}/{name}/terms"))
        (gone.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").cast("bigint").alias("len"))
         .write.parquet(f"{self.path}/{name}/numbers"))
        lost = int(gone.agg(F.sum(F.col("mark").cast("decimal(38,0)"))).first()[0] or 0)
        return self._next(self.segments, [*self.deletions, name], self.fingerprint - lost)

    def update(self, passages: DataFrame) -> "SegmentedIndex":
        """Replace, or add, the passages of these ids."""
        return self.delete(passages.select("chunk_id")).add(passages)

    def merge(self, factor: int = MERGE_FACTOR) -> "SegmentedIndex":
        """Tiered merge: ``factor`` or more segments whose live sizes lie within a power
        of ``factor`` become one without their deleted passages, until no tier
        has so many. Rows are rewritten once a tier, so a passage at most log(N) times."""
        from docsift.session import cut_lineage
        index = self
        while True:
            sizes = {r["part"]: r["n"] for r in index.passages().groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
            tiers: dict[int, list[str]] = {}
            for s in index.segments:
                tiers.setdefault(int(math.log(max(sizes.get(s, 0), 1), factor) + 1e-9), []).append(s)
            full = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= factor), None)
            if full is None:
                return index
            name = f"seg-{os.urandom(6).hex()}"
            rows = index.passages().filter(F.col("part").isin(full)).select("chunk_id", "dl", "mark", "terms")
            index._write_segment(cut_lineage(rows, "merged"), name)
            left = [s for s in index.segments if s not in full]
            used = {r["seg"]: None for r in index._part("numbers", index.deletions, "seg string").select("seg").distinct().collect()}
            # deletions that concern merged segments only are done with
            deletions = index.deletions if any(s in used for s in left) else []
            index = index._next([*left, name], deletions, index.fingerprint)

    # -------------------------------------------------------------- search
    def numbers(self) -> tuple[int, int]:
        """(passages, words) that are live."""
        schema = "n long, len long"
        has = self._part("numbers", self.segments, schema).agg(F.sum("n"), F.sum("len")).first()
        lost = self._live("numbers", "seg string, " + schema).agg(F.sum("n"), F.sum("len")).first()
        return (has[0] or 0) - (lost[0] or 0), (has[1] or 0) - (lost[1] or 0)

    def terms(self) -> DataFrame:
        """(term, df) over the live passages."""
        has = self._part("terms", self.segments, "term string, df long").select("term", "df")
        lost = self._live("terms", "seg string, term string, df long").select("term", (-F.col("df")).alias("df"))
        return has.unionByName(lost).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def mean_idf(self, n: int) -> float:
        if self._mean_idf is None:
            self._mean_idf = self.terms().agg(F.avg(lx._raw_idf(F.lit(float(n)), F.col("df")))).first()[0] or 0.0
        return self._mean_idf

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of live passages that share a word with a
        query; only the term buckets of the queries' words are read."""
        from docsift.session import cut_lineage
        n, words = self.numbers()
        if not n:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double")
        qt = cut_lineage(lx.query_terms(queries), "query-terms")
        wanted = qt.select("term").distinct()
        df = cut_lineage(self.terms().join(wanted, "term", "left_semi"), "query-df")
        buckets = [r[0] for r in wanted.select(lx.term_bucket(F.col("term"), TERM_BUCKETS)).distinct().collect()]
        few = df.count() <= lx.MAX_BROADCAST_TERMS and qt.count() <= lx.MAX_BROADCAST_TERMS
        hint = F.broadcast if few else (lambda d: d)
        post = (self._part("postings", self.segments, "term string, chunk_id long, tf long, dl int, tb int")
                .filter(F.col("tb").isin(buckets)))
        gone = self._live("ids", "seg string, chunk_id long").withColumnRenamed("seg", "part")
        post = post.join(hint(df), "term").join(broadcast_if_small(gone), ["part", "chunk_id"], "left_anti")
        weighed = lx.bm25_weights(post, float(n), words / n, self.mean_idf(n))
        return lx.query_chunk_scores(weighed, qt, few)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, rank, chunk_id, score): as ``bm25_top`` over the live passages."""
        return lx.top_k(self.scores(queries), k).select("query_id", "rank", "chunk_id", "score")
