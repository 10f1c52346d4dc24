"""Rows that fail: error codes, which of them may be tried again, and runs that try them again.

Lost tasks are Spark's to repeat; this is for rows whose own processing ends in a code.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

# Error codes by area.
CODES = {
    "unknown": 1000, "invalid_input": 1001, "timeout": 1002, "cancelled": 1003, "not_supported": 1004, "internal": 1005,
    "file_not_found": 2000, "file_empty": 2001, "file_too_large": 2002, "file_read_failed": 2003, "file_write_failed": 2004,
    "file_format": 2005, "file_permission": 2006, "file_locked": 2007,
    "processor_not_found": 3000, "processor_failed": 3001, "processor_timeout": 3002, "extraction_failed": 3003,
    "parsing_failed": 3004, "encoding_failed": 3005, "external_tool_missing": 3006, "external_tool_failed": 3007,
    "config_not_found": 4000, "config_invalid": 4001, "config_parsing": 4002, "config_value": 4003,
    "detection_failed": 5000, "no_content": 5001, "invalid_content": 5002,
}
# Codes that may be tried again, and how often a row is tried.
RECOVERABLE = ("timeout", "processor_failed", "external_tool_missing", "external_tool_failed")
ATTEMPTS = 3


def recoverable(code: Column, fatal: Column | None = None) -> Column:
    """Whether a code may be tried again; null and unknown codes may not, nor what is fatal."""
    may = F.coalesce(code.isin(*[CODES[c] for c in RECOVERABLE]), F.lit(False))
    return may if fatal is None else may & ~F.coalesce(fatal, F.lit(False))


def attempted(rows: DataFrame, process: Callable[[DataFrame, int], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """The rows as process left them, with code (null: done), recoverable and attempt, the last that each had.

    process(rows, attempt) adds code, and fatal if it tells it; it gets all rows first, then only those left with
    a recoverable code, without the columns added. Each attempt is a table on shared storage, so no row
    is processed twice for one attempt. Repeated rows stay.
    """
    if attempts < 1:
        raise ValueError("at least one attempt")
    ended, todo = [], rows
    for n in range(1, attempts + 1):
        out = process(todo, n)
        fatal = F.col("fatal") if "fatal" in out.columns else None
        done = written(out.withColumn("recoverable", recoverable(F.col("code"), fatal)).withColumn("attempt", F.lit(n)))
        if n == attempts:
            ended.append(done)
            break
        ended.append(done.where("not recoverable"))
        todo = done.where("recoverable").select(*rows.columns)
        if not todo.take(1):
            break
    return reduce(DataFrame.unionByName, ended)


def by_code(done: DataFrame) -> DataFrame:
    """How many rows ended with each code after each number of attempts."""
    return done.groupBy("code", "recoverable", "attempt").agg(F.count("*").alias("n"))
