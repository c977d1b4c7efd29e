"""Session helpers: a local session for tests and the bench, and the
shared checkpoint folder every lineage cut goes to."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on. AQE coalesces small shuffles, splits
# skewed join partitions and turns joins into broadcasts once the real
# (runtime) size of a side is known to be small.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Row groups of 16 MB: scans split stored tables across cores even when a
# table is a few files, and row-group statistics prune at a finer grain.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def get_session(cores: int | str = "*", shuffle_partitions: int = 8,
                app: str = "docsift") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster ``spark.checkpoint.dir`` names a shared file system path and
    is used as is. Only when it is unset (local tests) a folder is made here.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="docsift-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # core conf not settable at runtime: the context holds it
            pass
    spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame, name: str = "stage", path: str | None = None) -> DataFrame:
    """Cut lineage by writing the rows as Parquet under the shared
    checkpoint folder and reading them back: computed once, survives lost
    executors, and later scans get column pruning, filter pushdown and
    real size statistics (which AQE uses to pick join strategies)."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for written tables, in this application's own folder under
    the shared checkpoint folder (``clear_scratch`` removes it)."""
    return f"{_own_scratch(spark)}/{name}-{os.urandom(6).hex()}"


def _own_scratch(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), f"docsift-{spark.sparkContext.applicationId}")


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application wrote under the checkpoint folder.
    Call it when no DataFrame that reads those tables is needed any more."""
    drop_path(spark, _own_scratch(spark))


def drop_path(spark: SparkSession, where: str) -> None:
    """Remove a written table that no DataFrame reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def store_partitioned(df: DataFrame, name: str, part_col: str, spread_col: str | None = None,
                      spread: int = 4) -> DataFrame:
    """Like ``cut_lineage``, but written partitioned by ``part_col``; filters
    on ``part_col`` then prune whole directories at read time. Each value's
    rows go to at most ``spread`` writer tasks (hash of ``spread_col``), so
    a directory has a few files that later scans can read in parallel.
    Callers use it only for columns whose groups are bounded by
    construction (blocks of dense ids, term buckets)."""
    from pyspark.sql import functions as F
    path = scratch_path(df.sparkSession, name)
    keys = [F.col(part_col)]
    if spread_col is not None and spread > 1:
        keys.append(F.pmod(F.xxhash64(spread_col), F.lit(spread)))
    (df.repartition(*keys).write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
     .option("compression", "zstd").partitionBy(part_col).parquet(path))
    return df.sparkSession.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docsift`` importable in the Python workers (pandas kernels):
    once per application the package is zipped and added with
    ``addPyFile``, which copies it to every executor. The zip is a code
    artifact on the driver, not data."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="docsift-pkg-"), "docsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
