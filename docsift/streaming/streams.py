"""Structured Streaming forms: file feeds, alert sinks, deduplication, integrity watch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity, net

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_feed(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, at most so many a trigger."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def table_feed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ticks_feed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1 << 30) -> DataFrame:
    """New Parquet files below folder, at most so many a trigger; a scan of many files is no more micro-batches for it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(folder)


def run_to(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Deliver every micro-batch to sink; with once, all that is there and then end."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that overwrites one folder a batch, so a repeated batch leaves no copies."""

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


def first_per_horizon(stream: DataFrame, key: str, time: str, horizon: str = "1 hour") -> DataFrame:
    """The first row of a key within a horizon; state older than the watermark goes, so it stays bounded."""
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def network_alerts(stream: DataFrame, whitelist: DataFrame, time: str = "ts", ip: str = "remote_ip", horizon: str = "1 hour", block: bool = False) -> DataFrame:
    """One alert an address and horizon for connections that no whitelist entry covers."""
    found = net.violations(stream, whitelist, ip)
    alerts = first_per_horizon(found, ip, time, horizon)
    return alerts.withColumn("direction", net.direction(F.col("local_port"))).withColumn("action", F.lit("BLOCKED" if block else "DETECTED"))


def integrity_alerts(stream: DataFrame, baseline: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files whose digest differs from the baseline's, at every arrival while it does; deletions need the batch form."""
    now = stream.select(F.col(path).alias("path"), F.md5(content).alias("new"))
    known = baseline.select("path", F.col("digest").alias("old"))
    return now.join(known, "path").where("new <> old").select("path", F.lit("modified").alias("state"))


def windowed_counts(stream: DataFrame, time: str, key: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows by window and key; what is later than the watermark is left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def baseline_of(files: DataFrame) -> DataFrame:
    return integrity.baseline(files, "path", F.md5("content"))
