"""URL verdicts: host and path rules first, link-graph propagation for pages that no rule fits.

A page's rule is the longest that fits its host (or a parent domain) and the start of its path. Rules
also seed the hosts: a host's trust seed is the part of its pages that allow rules fit, its distrust
seed the part that block rules fit. Personalised PageRank spreads trust along the links between hosts
and distrust against them; both stay within 0 and 1. Distrust sent back is shared by all that link to a
host, so it shrinks as they grow in number; a host is therefore judged by its risk, which is distrust
averaged over the host's own links instead. It is blocked if its risk exceeds its trust and reaches the
threshold, half of what a host with only blocked pages and no links has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-4
ROUNDS = 60
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits. Rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the last test put on is the outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    dst = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)))
    links = pages.select(host_of(F.col(url_col)).alias("src"), dst.alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _UPPER.lower()))
    return links.where("src <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust, risk) of every seeded or linked host. seeds: host, trust, distrust; links: src, dst, n.

    Each round is one sum over links each way, written to shared storage; it ends when no score moves
    by more than the tolerance. Hosts without links never enter a round.
    """
    own = (1 - damping)
    links = common.written(links)
    if common.is_empty(links):
        return seeds.select("host", (own * F.col("trust")).alias("trust"), *[(own * F.col("distrust")).alias(c) for c in ("distrust", "risk")])
    out = links.groupBy("src").agg(F.sum("n").alias("out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("in"))
    flows = common.written(links.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("n") / F.col("out")).alias("ahead"), (F.col("n") / F.col("in")).alias("back")
    ))
    linked = flows.select(F.col("src").alias("host")).union(flows.select(F.col("dst").alias("host"))).distinct()
    base = common.written(linked.join(seeds, "host", "left").select(
        "host", (own * F.coalesce("trust", F.lit(0.0))).alias("t0"), (own * F.coalesce("distrust", F.lit(0.0))).alias("d0")
    ))
    now = base.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"), F.col("d0").alias("risk"))
    for _ in range(rounds):
        sent = flows.join(now.select(F.col("host").alias("src"), "trust"), "src").select(
            F.col("dst").alias("host"), (damping * F.col("trust") * F.col("ahead")).alias("t"), F.lit(0.0).alias("d"), F.lit(0.0).alias("r")
        ).unionByName(flows.join(now.select(F.col("host").alias("dst"), "distrust", "risk"), "dst").select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (damping * F.col("distrust") * F.col("back")).alias("d"),
            (damping * F.col("risk") * F.col("ahead")).alias("r"),
        )).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), F.sum("r").alias("r"))
        new = common.written(base.join(sent, "host", "left").join(now, "host").select(
            "host", (F.col("t0") + F.coalesce("t", F.lit(0.0))).alias("new_trust"),
            (F.col("d0") + F.coalesce("d", F.lit(0.0))).alias("new_distrust"),
            (F.col("d0") + F.coalesce("r", F.lit(0.0))).alias("new_risk"), "trust", "distrust", "risk",
        ))
        change = [F.abs(F.col(f"new_{c}") - F.col(c)) for c in ("trust", "distrust", "risk")]
        moved = new.agg(F.max(F.greatest(*change)).alias("m")).first()["m"]
        common.discard(now)
        now = new.select("host", F.col("new_trust").alias("trust"), F.col("new_distrust").alias("distrust"), F.col("new_risk").alias("risk"))
        now._docsift_path = new._docsift_path
        if moved <= TOLERANCE:
            break
    alone = seeds.join(linked, "host", "left_anti").select("host", (own * F.col("trust")).alias("trust"), *[(own * F.col("distrust")).alias(c) for c in ("distrust", "risk")])
    return now.unionByName(alone)


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, damping: float = DAMPING,
    threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, and the host's trust and distrust.

    A null url or one without :// has empty host and path, so no rule and no links of its own; null html
    has no links; repeated rows stay; other columns are ignored. A tie of scores allows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    named = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = common.written(ruled.groupBy("host").agg(
        F.avg(F.when(F.col("by_rule") == "allow", 1.0).otherwise(0.0)).alias("trust"),
        F.avg(F.when(F.col("by_rule") == "block", 1.0).otherwise(0.0)).alias("distrust"),
    ))
    scores = propagated(seeds, host_links(pages, url_col, html_col), damping)
    bad = (F.col("risk") > F.col("trust")) & (F.col("risk") >= threshold * (1 - damping))
    return ruled.join(scores, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", F.when(bad & (F.col("host") != ""), "block").otherwise("allow")).alias("verdict"), "trust", "distrust",
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
