"""The folder that the driver and all executors share, and tables written to it."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is set and all runs in one machine (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and survives lost executors. The shuffles
    behind the write are done with once it has ended, so their files go."""
    path, before = fresh_path(spark, tag), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._own_path = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared folder, through Hadoop's file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def used_up(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``materialise`` gave and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_own_path", None):
            discard(spark, path)
