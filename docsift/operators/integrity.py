"""Integrity of files against a baseline of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def baseline(files: DataFrame, path: str, digest: Column) -> DataFrame:
    """(path, digest) of the present state."""
    return files.select(F.col(path).alias("path"), digest.alias("digest"))


def drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state): deleted, unreadable (no digest now), modified or added; unchanged paths are left out."""
    b = before.select("path", F.col("digest").alias("old"), F.lit(True).alias("was"))
    n = now.select("path", F.col("digest").alias("new"), F.lit(True).alias("exists"))
    state = (
        F.when(F.col("exists").isNull(), "deleted").when(F.col("was").isNull(), "added").when(F.col("new").isNull(), "unreadable")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return b.join(n, "path", "full_outer").select("path", state.alias("state")).where("state is not null")
