"""Keyword sets, keyword rules as joins, and boolean keyword expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import once
from ..plans.packs import KEYWORD_ORDER, Pack
from .patterns import contained


def matched(low: Column, words: tuple[str, ...]) -> Column:
    """The words that occur in an already lower-cased text, in the set's order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]))


def set_rows(df: DataFrame, text: Column, pack: Pack, keep: list[str]) -> DataFrame:
    """keep and one row per set with a match: set_name, matched, count, score (count times the set's weight)."""
    lowered = once(df.select(*keep, text.alias("_text")), {"_low": F.lower("_text")})
    low = F.col("_low")
    one = lambda k: F.struct(F.lit(k).alias("set_name"), matched(low, pack.keywords[k]).alias("matched"), F.lit(pack.keyword_weights[k]).alias("weight"))
    rows = lowered.select(*keep, F.explode(F.array(*[one(k) for k in KEYWORD_ORDER])).alias("s"))
    return rows.where(F.size("s.matched") > 0).select(
        *keep, "s.set_name", "s.matched", F.size("s.matched").alias("count"), (F.size("s.matched") * F.col("s.weight")).alias("score")
    )


def keyword_score(text: Column, pack: Pack) -> Column:
    """Sum of count times weight over the sets, within 0 and 1."""

    def of(low: Column) -> Column:
        total = F.lit(0.0)
        for k in KEYWORD_ORDER:
            total = total + F.size(matched(low, pack.keywords[k])) * F.lit(pack.keyword_weights[k])
        return total

    total = F.element_at(F.transform(F.array(F.lower(text)), of), 1)  # lowered once, not in each word's test
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def last_rules(rules: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Of rules with one key the last by order."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc(), F.col("rule_id").desc())
    return rules.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def feature_rules(rules: DataFrame) -> DataFrame:
    """(feature, rule_id, rule_desc) from comma-separated contents, trimmed and lower-cased; of one feature the last rule wins."""
    each = rules.select("rule_id", "rule_desc", "ord", F.explode(F.split("rule_content", ",")).alias("f"))
    each = each.select(F.lower(F.trim("f")).alias("feature"), "rule_id", "rule_desc", "ord").where("feature <> ''")
    return last_rules(each, ["feature"]).drop("ord")


def feature_hits(df: DataFrame, text: Column, rules: DataFrame, keep: list[str]) -> DataFrame:
    """keep and a row per feature that the text contains, for any number of features; null and empty texts have none."""
    flat = feature_rules(rules).withColumn("_pattern", F.col("feature").cast("binary"))
    texts = df.select(F.struct(*keep).alias("_row"), F.lower(text).cast("binary").alias("_low"))
    found = contained(texts, "_low", flat, "_pattern").drop("_low").join(flat, "_pattern")
    return found.select("_row.*", "feature", "rule_id", "rule_desc")


_TOKEN = re.compile(r"\s*(?:(\()|(\))|(AND|OR|NOT)(?![^\s()])|([^\s()]+))")


def expression(text: Column, source: str, min_match_count: int = 1) -> Column:
    """A boolean keyword expression as a Column: words, AND, OR, NOT, parentheses; adjacent words are AND.

    Our own grammar for declared rules. Besides the expression, min_match_count of its words not under
    NOT have to occur. Malformed expressions raise ValueError.
    """
    tokens = [next(t for t in m if t) for m in _TOKEN.findall(source.strip())]
    low, at, words = F.lower(text), 0, []

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def either(neg: bool) -> Column:
        nonlocal at
        left = both(neg)
        while peek() == "OR":
            at += 1
            left = left | both(neg)
        return left

    def both(neg: bool) -> Column:
        nonlocal at
        left = single(neg)
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                at += 1
            left = left & single(neg)
        return left

    def single(neg: bool) -> Column:
        nonlocal at
        t = peek()
        if t is None or t in (")", "AND", "OR"):
            raise ValueError(f"keyword expected in {source!r}")
        at += 1
        if t == "NOT":
            return ~single(not neg)
        if t == "(":
            inner = either(neg)
            if peek() != ")":
                raise ValueError(f"unbalanced parentheses in {source!r}")
            at += 1
            return inner
        c = F.contains(low, F.lit(t.lower()))
        if not neg:
            words.append(c)
        return c

    out = either(False)
    if at != len(tokens):
        raise ValueError(f"unbalanced parentheses in {source!r}")
    if min_match_count > 1:
        out = out & (sum((w.cast("int") for w in words), F.lit(0)) >= min_match_count)
    return out
