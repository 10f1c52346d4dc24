"""Counters of the monitors after every micro-batch: scans, what they checked, alerts, blocked addresses.

A sink leaves two small tables a batch, overwritten if the batch is repeated: what it checked, and whom it
alerts of. Totals are sums over them, so nothing is held on the driver and a restart goes on counting.
The same functions count rows that carry the number of their batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import net

COUNTS = "checked bigint, batch bigint"
SEEN = "subject string, n bigint, batch bigint"


def network_seen(connections: DataFrame, whitelist: DataFrame, ip: str = "remote_ip") -> DataFrame:
    """(subject, n): addresses to be blocked and their connections. Null and empty addresses are skipped."""
    found = net.violations(connections.where(F.col(ip) != ""), whitelist, ip)
    return found.groupBy(*_kept(found), F.col(ip).alias("subject")).agg(F.count("*").alias("n"))


def integrity_seen(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """(subject, n): checks of a known path whose digest is null (no access) or not the baseline's."""
    known = baseline.select("path", F.col("digest").alias("_old"))
    odd = files.join(known, "path").where(F.col("digest").isNull() | (F.col("digest") != F.col("_old")))
    return odd.groupBy(*_kept(odd), F.col("path").cast("string").alias("subject")).agg(F.count("*").alias("n"))


def _kept(df: DataFrame) -> list[str]:
    return ["batch"] if "batch" in df.columns else []


def counted(rows: DataFrame) -> DataFrame:
    """(checked): how many rows, by batch if they have it."""
    return rows.groupBy(*_kept(rows)).agg(F.count("*").alias("checked"))


def totals(counts: DataFrame, seen: DataFrame, once: bool) -> DataFrame:
    """(batch, scans, checked, alerts): running totals after each batch.

    once: a subject is alerted of in its first batch only (blocked addresses); else at every check. The
    windows hold one row a batch. A batch without rows counts as a scan if counts has it.
    """
    if once:
        alerts = seen.groupBy("subject").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("_n"))
    else:
        alerts = seen.groupBy("batch").agg(F.sum("n").alias("_n"))
    up = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(alerts, "batch", "left").select(
        F.col("batch").cast("bigint").alias("batch"), F.count("*").over(up).alias("scans"), F.sum("checked").over(up).alias("checked"),
        F.sum(F.coalesce("_n", F.lit(0))).over(up).alias("alerts"),
    )


def sink(path: str, seen: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink for run_to() that counts a batch and stores the subjects that seen finds in it."""

    def put(df: DataFrame, batch: int) -> None:
        seen(df).write.mode("overwrite").parquet(f"{path}/seen/batch={batch}")
        counted(df).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")

    return put


def streamed(spark: SparkSession, path: str, once: bool) -> DataFrame:
    """totals() of what a sink has stored so far."""
    return totals(spark.read.schema(COUNTS).parquet(f"{path}/counts"), spark.read.schema(SEEN).parquet(f"{path}/seen"), once)


def blocked(spark: SparkSession, path: str) -> DataFrame:
    """(subject, batch): every blocked address and the batch that blocked it."""
    return spark.read.schema(SEEN).parquet(f"{path}/seen").groupBy("subject").agg(F.min("batch").alias("batch"))
