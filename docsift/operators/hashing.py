"""File digests, and rules that list digests or byte patterns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .keywords import last_rules
from .markers import hit
from .patterns import first_rule

MD5, SM3 = 0, 1
MOST_BYTES = 100 << 20
HASH_LEVEL, HASH_ALERT = 4, 99


def sm3(content: Column) -> Column:
    """SM3 as lower-case hexadecimal digits; the JVM has no SM3, so in Arrow batches."""
    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else hashlib.new("sm3", bytes(b)).hexdigest())

    return digest(content)


def hash_hits(files: DataFrame, rules: DataFrame, keep: list[str], content: str = "content", types: tuple[int, ...] = (MD5, SM3)) -> DataFrame:
    """keep and a hit for every digest of a file that a rule lists.

    Rules: rule_id, rule_type (0 MD5, 1 SM3), rule_content, rule_desc, ord; of rules with one digest the
    last wins. Empty files and such over 100 MiB are skipped. Digests are compared as they are written;
    only types named are computed. An equi-join: whichever side is small is broadcast by its size.
    """
    c = F.col(content)
    sized = files.where((F.octet_length(c) > 0) & (F.octet_length(c) <= MOST_BYTES))
    of = {MD5: F.md5(c), SM3: sm3(c) if SM3 in types else F.lit(None)}
    each = sized.select(*keep, F.explode(F.array(*[F.struct(F.lit(t).alias("rule_type"), of[t].alias("digest")) for t in types])).alias("d"))
    known = last_rules(rules, ["rule_type", "rule_content"]).select("rule_type", F.col("rule_content").alias("digest"), "rule_id", "rule_desc")
    joined = each.select(*keep, "d.rule_type", "d.digest").join(known, ["rule_type", "digest"])
    kind = F.when(F.col("rule_type") == MD5, "MD5").otherwise("SM3")
    desc = F.when(F.coalesce(F.col("rule_desc"), F.lit("")) != "", F.col("rule_desc")).otherwise(F.concat(kind, F.lit(" hash rule")))
    return joined.select(*keep, "rule_type", hit(F.lit(True), F.lit(HASH_LEVEL), F.col("rule_id"), desc, F.col("digest"), kind, HASH_ALERT).alias("hit"))


def rules_of(files: DataFrame, content: str, name: str, first_id: int = 1001) -> DataFrame:
    """MD5 rules from files, numbered by name (then digest) from first_id, by a range sort over many tasks."""
    named = files.select(F.col(name).alias("rule_desc"), F.md5(content).alias("rule_content"))
    rows = numbered(named, ["rule_desc", "rule_content"], "rule_id", first_id)
    return rows.select("rule_id", F.lit(MD5).alias("rule_type"), "rule_content", "rule_desc", (F.col("rule_id") - first_id + 1).alias("ord"))


def byte_pattern_hits(files: DataFrame, rules: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """keep and the first rule (by rule_id) whose base64-coded bytes the file contains: rule_id, rule_desc.

    Any number of rules (patterns.first_rule); empty patterns and empty files have no hit, repeated rows stay.
    """
    known = rules.select("rule_id", "rule_desc", F.unbase64("rule_content").alias("_bytes"))
    found = first_rule(files.select(F.struct(*keep).alias("_row"), F.col(content).alias("_content")), "_content", known, "_bytes", ["rule_id", "rule_desc"])
    return found.select("_row.*", F.col("first.rule_id").alias("rule_id"), F.col("first.rule_desc").alias("rule_desc"))


def duplicate_contents(files: DataFrame, content: str, id_col: str) -> DataFrame:
    """digest, copies and first id of contents that occur more than once."""
    return files.groupBy(F.md5(content).alias("digest")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")
