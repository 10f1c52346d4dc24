"""Summaries of scans and batches, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def scan_summary(df: DataFrame, error: Column, detected: Column, size: Column, by: list[str] | None = None) -> DataFrame:
    """total, errors, detected (not in error), missed, bytes."""
    ok = ~error
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), count_if(error).alias("errors"), count_if(ok & detected).alias("detected"),
        count_if(ok & ~detected).alias("missed"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"),
    )


def batch_summary(df: DataFrame, success: Column, official: Column) -> DataFrame:
    """total, success, failed, official, other."""
    return df.agg(
        F.count("*").alias("total"), count_if(success).alias("success"), count_if(~success).alias("failed"),
        count_if(success & official).alias("official"), count_if(success & ~official).alias("other"),
    )


def error_counts(df: DataFrame, severity: str, code: str) -> DataFrame:
    """Errors and warnings by code."""
    return df.groupBy(severity, code).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def most_common(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by and the most common value (the least of equals) with its count."""
    n = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def distinct_in_order(values: Column) -> Column:
    """An array without repeats, first ones kept."""
    return F.array_distinct(values)


# Kind, subject and risk of security events, the greatest length of their messages in characters.
ABNORMAL, SIGNATURE, NETWORK = 1, ("签名异常", 4), ("通信 IP 异常", 3)
MESSAGE = 128


def _event(subject: tuple[str, int], time: Column, message: Column) -> Column:
    name, risk = subject
    return F.struct(
        F.lit(ABNORMAL).alias("event_type"), F.lit(name).alias("event_sub_type"), time.alias("time"),
        F.lit(risk).alias("risk"), F.left(message, F.lit(MESSAGE)).alias("msg"),
    )


def signature_event(time: Column, message: Column) -> Column:
    """A file whose signature is wrong; a null message is empty."""
    return _event(SIGNATURE, time, F.coalesce(message, F.lit("")))


def network_event(time: Column, remote_ip: Column, message: Column) -> Column:
    """A connection that is not allowed; without a message (null or empty) one that names the address."""
    named = F.concat(F.lit("Detected unauthorized communication with "), F.coalesce(remote_ip, F.lit("")))
    return _event(NETWORK, time, F.when(message != "", message).otherwise(named))
