"""The training-data pipeline over ``documents``: five stages, each one of the
operators of ``docsift.llm``, each on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's result
under the shared checkpoint folder and reads it back for the next.

Defined results: null, empty and wordless texts are scored as any other by the first
stage and go at the second, which can't tell their language; a document
is an id with a text, so that ids on several texts are decided text by text; repeated
rows are one document for the third stage; rows with a null id are kept by it; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import decontaminate, language, ngram_join, pack, quality
from docsift.llm.common import stored, table
from docsift.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SCORE = 0.5


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and row_key, equal for rows of equal id and text."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rule-ensemble quality: documents that score under 0.5 go."""
    ship_package(spark)
    ensemble = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, ensemble, COLUMNS).filter("predicted = 1").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word-first language identification: documents without a language, or
    that no language explains better than the others together, go."""
    ship_package(spark)
    model = language.learn(docs)
    p = language.predicted(F.col("text"), model, spark)
    return (docs.select(*COLUMNS, p.alias("p"))
            .filter((F.col("p.lang_pred") != language.UNDETERMINED) & (F.col("p.score") >= MIN_LANGUAGE_SCORE))
            .select(*COLUMNS))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document of
    the smallest id stays (of several texts of that id, one)."""
    ship_package(spark)
    keyed = _keyed(docs).withColumn("row_key", F.when(F.col("doc_id").isNotNull(), F.col("row_key")))
    groups = (ngram_join.near_duplicates(keyed, "row_key").filter("row_key is not null").groupBy("row_key")
              .agg(F.min("component_id").alias("component"), F.min("n_shingles").alias("n"), F.count("*").alias("copies")))
    ids = keyed.filter("doc_id is not null").groupBy("row_key").agg(F.min("doc_id").alias("doc_id"))
    leads = (groups.join(ids, "row_key").groupBy("component")
             .agg(F.min(F.struct("doc_id", "row_key", "n", "copies")).alias("d")))
    leads = stored(leads.select(F.col("d.row_key").alias("k"), "d.n", "d.copies"), "leaders")
    # One job, one join of the texts; nulls and keys on one row pass without a sort.
    kept = keyed.join(leads, F.col("row_key") == F.col("k"), "left")
    once = kept.filter("doc_id is null or copies = 1").select(*COLUMNS)
    several = leads.filter("copies > 1")
    if several.isEmpty():
        return once
    # Texts without words are alike in nothing, so only equal rows of them become one.
    apart = F.when(F.col("n") == 0, F.struct("lang", "source", "n_chars"))
    picked = (keyed.join(several, F.col("row_key") == F.col("k")).groupBy("row_key", apart.alias("apart"))
              .agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*"))
    return once.unionByName(picked)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Positional index against ``benchmark``: documents that hold a run of ten
    consecutive words of an item go."""
    ship_package(spark)
    keyed = _keyed(docs)
    found = decontaminate.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="row_key")
    hit = stored(found.filter("contaminated").select("row_key").distinct(), "contaminated")
    return keyed.join(hit, "row_key", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all that is left, with their places."""
    ship_package(spark)
    return pack.pack_documents(docs, pack.tokenizer_path(pack.TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Fitted models decide the first two stages, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
