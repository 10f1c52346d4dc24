"""From files to marker hits: the type of the bytes picks the scan, and a failed extraction falls back to bytes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import trim
from ..plans.packs import Pack
from . import markers, sniff
from .alerts import MARKER_ALERT, PRIORITY

OCR_LIMIT = 20 << 20
PAGES = 5  # of a PDF that are searched
LEAST_LEVEL = 4  # of a marker whose word has no level of its own
DESC = "密级标志检测命中: "


def page_hit(pages: Column, pack: Pack) -> tuple[Column, Column]:
    """(matched, level) of the first of the first pages with a strict marker, its page named; '' and 0 without one."""

    def one(page: Column, i: Column) -> Column:
        m, level = markers.strict(page, pack)
        return F.struct(trim(m).alias("m"), level.alias("l"), (i + 1).alias("n"))

    first = F.get(F.filter(F.transform(F.slice(pages, 1, PAGES), one), lambda x: x["m"] != ""), F.lit(0))
    named = F.concat(first["m"], F.lit(" (Page "), first["n"].cast("string"), F.lit(")"))
    return F.coalesce(named, F.lit("")), F.coalesce(first["l"], F.lit(0))


def marker_hit(content: Column, text: Column, pack: Pack, image_text: Column | None = None, pages: Column | None = None) -> Column:
    """The marker detector's hit for a file's bytes; null without one.

    text: what an extractor made of office and PDF files, null where it failed (their bytes are scanned
    then). pages: the pages of PDF files, of which the first five are searched; null where they can't be
    read. Plain text is read at its head and tail; images only where image_text is given, up to 20 MB, for
    bare marker words too; all else by bytes. Null and empty contents have no hit.
    """
    kind = sniff.marker_type(content)
    (m1, l1), (m2, l2), (m3, l3) = markers.strict(text, pack), markers.head_tail(content, pack), markers.byte_scan(content, pack)
    matched, level = F.when(kind == "text", m2), F.when(kind == "text", l2)
    if pages is not None:
        (m5, l5), paged = page_hit(pages, pack), (kind == "pdf") & pages.isNotNull()
        matched, level = matched.when(paged, m5), level.when(paged, l5)
    parsed = kind.isin("office", "pdf") & text.isNotNull()
    matched, level = matched.when(parsed, m1), level.when(parsed, l1)
    if image_text is None:
        matched, level = matched.when(kind == "image", ""), level.when(kind == "image", 0)
    else:
        m4, l4 = markers.loose(F.when(F.octet_length(content) <= OCR_LIMIT, image_text).otherwise(""), pack)
        named = F.when(m4 != "", F.concat(trim(m4), F.lit(" (OCR)"))).otherwise("")
        matched, level = matched.when(kind == "image", named), level.when(kind == "image", l4)
    matched, level = trim(matched.otherwise(m3)), level.otherwise(l3)
    desc = F.concat(F.lit(DESC), matched)
    known = F.when(level == 0, LEAST_LEVEL).otherwise(level)
    return markers.hit((F.octet_length(content) > 0) & (matched != ""), known, F.lit(0), desc, matched, F.lit(""), MARKER_ALERT)


def electronic_input(content: Column, name: Column) -> Column:
    """image or document: how the electronic-marker detector reads a file; null for those that it passes over."""
    kind = sniff.detector_type(content, name)
    return F.when((F.octet_length(content) > 0) & kind.isin("image", "document"), kind)


def switched_on(explicit: Iterable[str] = (), everything: bool = False, none: bool = False, loaded: Iterable[str] = ()) -> list[str]:
    """The detectors that run, by priority: all unless some are named or none is asked for; loaded rules turn theirs on."""
    named = set(explicit)
    on = set(PRIORITY) if everything or not (named or none) else named
    return [d for d in PRIORITY if d in on | set(loaded)]
