"""Which texts contain which patterns, as equi-joins, for any number of patterns.

Every pattern has one key: the hash of one short window of its bytes, chosen so that any text that
contains the pattern has the same window among its own keys. The texts' keys meet the patterns' keys in
an ordinary join, and what meets is verified by comparing bytes. Patterns are in tiers by their length;
a text's keys in a tier are the least hashes of all runs of consecutive windows (winnowing), so they are
few (about 2 in 65 bytes for the longest tier), and a pattern of a tier's length or more holds at least
one whole run. Patterns under 8 bytes are their own window, and a text's keys are its different strings
of that length. Only tiers that the patterns use are computed.

Of a pattern's possible keys the one that fewest patterns share is taken, so patterns with a common
beginning don't meet at one key. Up to FEW keys of patterns are sent to the tasks, and texts give out only
keys that are among them; beyond, all keys of texts meet them in the join. Texts move only where a key of
theirs met a pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

TIERS = (128, 32, 8)  # least lengths in bytes; below the last, each length by itself
BLOCK = 1 << 20
FEW = 100_000  # pattern keys that go to the tasks, 0.8 MB, so that texts give out only keys that meet one
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def tier_of(length: Column) -> Column:
    """The tier of a pattern of so many bytes."""
    out = length
    for t in reversed(TIERS):
        out = F.when(length >= t, t).otherwise(out)
    return out.cast("int")


def _packed(data: np.ndarray, width: int) -> np.ndarray:
    """Each window of under 8 bytes as a number."""
    n = len(data) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return h


def _hashed(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window; width is a power of two, doubled up to."""
    h, span, base = data.astype(np.uint64), 1, _BASE
    while span < width:
        h = h[:-span] * np.uint64(base) + h[span:]
        span, base = span * 2, base * base % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(32))


def keys(data: bytes, tier: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The different keys of some bytes in a tier, ascending, of wanted ones (ascending) if given; none if they are shorter than the tier."""
    if len(data) < tier:
        return np.zeros(0, np.int64)
    short = tier < TIERS[-1]
    width, run = (tier, 1) if short else (tier // 2, tier // 2 + 1)
    found, raw = [], np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - tier + 1, BLOCK):
        part = raw[at : at + BLOCK + tier - 1]
        h, span = (_packed if short else _hashed)(part, width), 1
        while span * 2 <= run:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < run:
            h = np.minimum(h[: len(h) - (run - span)], h[run - span :])
        h = h.view(np.int64)
        if wanted is not None:
            h = h[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h]
        found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def _keyed(df: DataFrame, content: str, tiers: list[int], own_tier: bool = False, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """df without content, and tier and keys (array): of each tier, or with own_tier of the row's own column tier."""
    names = [c for c in df.columns if c not in (content, "tier")]
    src = df.select(*names, *["tier"] * own_tier, F.col(content).alias("_content"))
    kinds = dict(src.dtypes)

    def run(batches):
        for b in batches:
            at, tier, found = [], [], []
            mine = b.column(len(names)) if own_tier else None
            for i, c in enumerate(b.column(b.num_columns - 1)):
                data = c.as_py()
                for t in [mine[i].as_py()] if own_tier else tiers:
                    k = keys(data, t, wanted and wanted[t]) if data else ()
                    if len(k):
                        at.append(i)
                        tier.append(t)
                        found.append(k)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(len(names))], pa.array(tier, pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=[*names, "tier", "keys"])

    return src.mapInArrow(run, ", ".join([*[f"`{n}` {kinds[n]}" for n in names], "tier int", "keys array<long>"]))


def pattern_keys(patterns: DataFrame, pattern: str) -> DataFrame:
    """(_pattern, tier, key) of the different patterns (binary) that are not empty: for each the key that fewest share."""
    each = patterns.select(F.col(pattern).alias("_pattern")).where(F.octet_length("_pattern") > 0).distinct()
    sized = each.select("_pattern", F.col("_pattern").alias("_bytes"), tier_of(F.octet_length("_pattern")).alias("tier"))
    every = _keyed(sized, "_bytes", [], own_tier=True).select("_pattern", "tier", F.explode("keys").alias("key"))
    shared = every.groupBy("tier", "key").agg(F.count("*").alias("_n"))
    rarest = F.min(F.struct("_n", "key"))
    return every.join(shared, ["tier", "key"]).groupBy("_pattern", "tier").agg(rarest.alias("_k")).select("_pattern", "tier", F.col("_k.key").alias("key"))


def candidates(texts: DataFrame, content: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """(_digest, _pattern): MD5 of texts and the different patterns that share a key with them; a superset of what they contain."""
    known = written(pattern_keys(patterns, pattern))
    tiers = sorted(r.tier for r in known.select("tier").distinct().collect())  # ten at most
    few = known.select("tier", "key").distinct().limit(FEW + 1).collect()
    wanted = {t: np.array(sorted(r.key for r in few if r.tier == t), np.int64) for t in tiers} if len(few) <= FEW else None
    t = texts.select(F.md5(content).alias("_digest"), F.col(content).alias("_content")).where(F.octet_length("_content") > 0)
    found = _keyed(t, "_content", tiers, wanted=wanted).select("_digest", "tier", F.explode("keys").alias("key"))
    return found.join(known, ["tier", "key"]).select("_digest", "_pattern").distinct()


def contained(texts: DataFrame, content: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """A row for each row of texts and each different pattern that it contains: its columns and _pattern.

    content and pattern are binary columns; null and empty ones meet nothing; repeated rows stay.
    """
    met = candidates(texts, content, patterns, pattern)
    held = texts.withColumn("_digest", F.md5(content)).join(met, "_digest")
    return held.where(F.contains(content, "_pattern")).drop("_digest")


def first_rule(texts: DataFrame, content: str, rules: DataFrame, pattern: str, order: list[str]) -> DataFrame:
    """texts' rows that contain a pattern, with first: of the rules whose pattern they contain the least by order.

    Found for each different text, then given to its rows, so repeated rows stay; rows without a hit are
    left out.
    """
    least = rules.groupBy(F.col(pattern).alias("_pattern")).agg(F.min(F.struct(*order)).alias("_rule"))
    pairs = contained(texts.select(F.col(content).alias("_content")), "_content", rules, pattern).select(F.md5("_content").alias("_digest"), "_pattern")
    best = pairs.join(least, "_pattern").groupBy("_digest").agg(F.min("_rule").alias("first"))
    return texts.withColumn("_digest", F.md5(content)).join(best, "_digest").drop("_digest")
