"""Classification markers: strict and loose patterns, window scans, byte scans, and which one a row gets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regex import to_java
from ..plans.packs import Pack

HEAD, TAIL = 4096, 2048
BYTE_LIMIT = 1 << 20

#: The hit that every detector gives: is_secret, level, rule_id, rule_desc, matched, context, alert_type.
HIT = "struct<is_secret:boolean,level:int,rule_id:bigint,rule_desc:string,matched:string,context:string,alert_type:int>"


def hit(found: Column, level: Column, rule_id: Column, desc: Column, matched: Column, context: Column, alert_type: int) -> Column:
    """The hit struct where found, else null."""
    return F.when(found, F.struct(
        F.lit(True).alias("is_secret"), level.cast("int").alias("level"), rule_id.cast("bigint").alias("rule_id"), desc.alias("rule_desc"),
        matched.alias("matched"), context.alias("context"), F.lit(alert_type).alias("alert_type"),
    ))


def level_of(word: Column, pack: Pack) -> Column:
    """Interchange level of a marker word; 0 if it is none."""
    out = F.lit(0)
    for w, level in reversed(pack.levels):
        out = F.when(word == w, level).otherwise(out)
    return out


def strict(text: Column, pack: Pack) -> tuple[Column, Column]:
    """(matched, level) of the leftmost strict marker; '' and 0 without one."""
    p = to_java(pack.strict_marker)
    return F.regexp_extract(text, p, 0), level_of(F.regexp_extract(text, p, 1), pack)


def loose(text: Column, pack: Pack) -> tuple[Column, Column]:
    """(matched, level) of the leftmost bare marker word."""
    p = to_java(pack.loose_marker)
    return F.regexp_extract(text, p, 0), level_of(F.regexp_extract(text, p, 1), pack)


def windows(content: Column) -> tuple[Column, Column]:
    """The first HEAD bytes, and the last TAIL at most of what follows them, as UTF-8."""
    n = F.octet_length(content)
    tail = F.greatest(F.lit(HEAD), n - TAIL)
    decode = lambda b: F.make_valid_utf8(b.cast("string"))  # noqa: E731  (a window may cut a character)
    return decode(F.substring(content, 1, HEAD)), decode(F.when(n > HEAD, F.substring(content, tail + 1, F.lit(TAIL))).otherwise(F.lit(b"")))


def head_tail(content: Column, pack: Pack) -> tuple[Column, Column]:
    """(matched, level) of the head, else of the tail."""
    first, last = windows(content)
    (m1, l1), (m2, l2) = strict(first, pack), strict(last, pack)
    return F.when(m1 != "", m1).otherwise(m2), F.when(m1 != "", l1).otherwise(l2)


def byte_scan(content: Column, pack: Pack) -> tuple[Column, Column]:
    """(label, level) of the first byte word of the pack in the first BYTE_LIMIT bytes; '' and 0 without one."""
    part = F.substring(content, 1, BYTE_LIMIT)
    label, level = F.lit(""), F.lit(0)
    for name, _, n, form in reversed(pack.byte_words):
        found = F.contains(part, F.lit(bytes.fromhex(form)))
        label, level = F.when(found, name).otherwise(label), F.when(found, n).otherwise(level)
    return label, level
