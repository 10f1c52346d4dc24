"""Policies as streams of operations on rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(ops: DataFrame, version: str = "version") -> DataFrame:
    """The rules in force after operations (module, version, cmd add|del|reset, rule_id, rule_content).

    A reset replaces all earlier rules of its module (a null rule_id: by none); of later operations on
    a rule the last wins, and a deleted rule is gone. Of operations of one version on one rule a deletion
    wins, else the greater content.
    """
    last_reset = ops.where("cmd = 'reset'").groupBy("module").agg(F.max(version).alias("_reset"))
    live = ops.join(last_reset, "module", "left").where(F.col("_reset").isNull() | (F.col(version) >= F.col("_reset"))).where("rule_id is not null")
    w = Window.partitionBy("module", "rule_id").orderBy(F.col(version).desc(), (F.col("cmd") == "del").desc(), F.coalesce("rule_content", F.lit("")).desc())
    top = live.withColumn("_r", F.row_number().over(w)).where("_r = 1 and cmd <> 'del'")
    return top.select("module", "rule_id", "rule_content", version)


def outcomes(ops: DataFrame, known: DataFrame, version: str = "version") -> DataFrame:
    """(module, version, cmd, ok, failed): per operation how many rules it could apply; deleting an unknown rule fails."""
    k = known.select("module", "rule_id", F.lit(True).alias("_known"))
    each = ops.where("rule_id is not null").join(k, ["module", "rule_id"], "left")
    bad = (F.col("cmd") == "del") & F.col("_known").isNull()
    return each.groupBy("module", version, "cmd").agg(F.count(F.when(~bad, 1)).alias("ok"), F.count(F.when(bad, 1)).alias("failed"))


def reports(done: DataFrame, time: Column, most: int = 128) -> DataFrame:
    """(time, type, cmd, module, version, success, fail): per operation the rules it was applied to and those it failed on, with why.

    done: module, version, cmd, rule_id, ok, msg. Both lists are in order of rule_id; of why the first most characters.
    """
    item = F.struct("rule_id", F.left(F.coalesce("msg", F.lit("")), F.lit(most)).alias("msg"))
    return done.groupBy("module", "version", "cmd").agg(
        F.sort_array(F.collect_list(F.when(F.col("ok"), F.col("rule_id")))).alias("success"), F.sort_array(F.collect_list(F.when(~F.col("ok"), item))).alias("fail")
    ).select(time.alias("time"), F.lit("policy").alias("type"), "cmd", "module", F.col("version").cast("string").alias("version"), "success", "fail")


def size_filter(size: Column, least_kb: Column, most_kb: Column) -> Column:
    """Whether a size in bytes is within optional bounds in KB."""
    return (least_kb.isNull() | (size >= least_kb * 1024)) & (most_kb.isNull() | (size <= most_kb * 1024))
