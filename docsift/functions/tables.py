"""Tables on shared storage, and row numbers without one task that holds all rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder path below spark.checkpoint.dir.

    Where that is unset, a session in one process gets a temporary folder of its own; on a cluster there
    is no folder that all executors are known to share, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="docsift-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docsift/{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """What is run within deletes its shuffle files when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table on shared storage: lineage ends there and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with name, the place of a row by order, counted from first; rows that tie in order follow one another anyhow.

    One range sort, stored, and the counts of its partitions: window and broadcast hold a row for each partition.
    """
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(cut.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_c"))
    parts = parts.select("_part", (F.coalesce(F.sum("_c").over(up), F.lit(0)) - F.col("_first") + first).alias("_add"))
    return rows.join(F.broadcast(parts), "_part").withColumn(name, (F.col("_row") + F.col("_add")).cast("bigint")).drop("_part", "_row", "_add")
