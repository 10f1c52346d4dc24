"""Text functions as Columns: trimming, stripping of markup, normalisation, truncation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming removes (Unicode), as a regular-expression class body.
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CHARACTERS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Named character references, in the order in which they are replaced (&amp; ends the first group).
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"),
    ("&copy;", "\u00a9"), ("&reg;", "\u00ae"), ("&mdash;", "\u2014"), ("&ndash;", "\u2013"), ("&ldquo;", "\u201c"), ("&rdquo;", "\u201d"),
    ("&lsquo;", "\u2018"), ("&rsquo;", "\u2019"), ("&hellip;", "\u2026"), ("&bull;", "\u2022"), ("&trade;", "\u2122"),
)
#: Full-width punctuation and its ASCII form.
FULL_WIDTH = "：，。；（）【】"
HALF_WIDTH = ":,.;()[]"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.trim(c, F.lit(SPACE_CHARACTERS))


def preprocess(c: Column) -> Column:
    """Trimmed, CRLF and CR as LF, at most one empty line in a row."""
    lf = F.replace(F.replace(trim(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lf, "\n{3,}", "\n\n")


def normalize_whitespace(c: Column) -> Column:
    """CRLF and CR as LF, every line trimmed, 3 or more LF as 2, runs of blanks and tabs as one blank, trimmed."""
    lf = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.array_join(F.transform(F.split(lf, "\n", -1), trim), "\n")
    return trim(F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), "[ \\t]+", " "))


def normalize_punctuation(c: Column) -> Column:
    """LF line ends and ASCII punctuation."""
    lf = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.translate(lf, FULL_WIDTH, HALF_WIDTH)


def named_entities(c: Column) -> Column:
    """Named character references decoded, one after the other."""
    for name, text in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(text))
    return c


def strip_html(c: Column) -> Column:
    """Every tag as a blank, then named references decoded."""
    return named_entities(F.regexp_replace(c, "<[^>]*>", " "))


def strip_xml(c: Column) -> Column:
    """Declaration dropped, CDATA unwrapped, tags as blanks."""
    c = F.regexp_replace(c, r"<\?xml[^?]*\?>", "")
    c = F.regexp_replace(c, r"(?d)<!\[CDATA\[(.*?)\]\]>", "$1")
    return F.regexp_replace(c, "<[^>]*>", " ")


def truncate(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def truncate_bytes(c: Column, n: int) -> Column:
    """The first n bytes of the UTF-8 form, as binary."""
    return F.substring(c.cast("binary"), 1, n)


def cut_bytes(c: Column, n: int) -> Column:
    """As many whole characters as fit into n bytes of UTF-8."""
    fit = F.char_length(F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string")))  # the last may be a part
    most = F.left(c, fit)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.when(F.octet_length(most) <= n, most).otherwise(F.left(c, fit - 1)))


def size_text(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals."""
    step = lambda n, unit: F.format_string(f"%.2f {unit}", c / F.lit(float(n)))
    return (
        F.when(c >= 1 << 30, step(1 << 30, "GB")).when(c >= 1 << 20, step(1 << 20, "MB"))
        .when(c >= 1 << 10, step(1 << 10, "KB")).otherwise(F.format_string("%d B", c))
    )


def without_short_noise(c: Column) -> Column:
    """Without lines of at most 2 bytes that hold no letter, digit or Han character (recognition noise)."""
    noise = lambda x: (F.octet_length(x) <= 2) & ~x.rlike(r"[\p{IsHan}A-Za-z0-9]")
    lines = F.transform(F.split(c, "\n", -1), trim)
    return F.array_join(F.filter(lines, lambda x: ~noise(x)), "\n")


#: The dashes of page numbers.
DASHES = "-\u2010\u2011\u2013\u2014\u2212"


def is_page_marker(line: Column) -> Column:
    """A line of digits in at most 4 bytes, or of digits, blanks and at least 2 dashes in under 20 bytes."""
    t = trim(line)
    dashed = t.rlike(rf"^[\p{{Nd}} \{DASHES}]+\z") & t.rlike(r"\p{Nd}")
    dashes = F.char_length(t) - F.char_length(F.translate(t, DASHES, ""))
    return (t.rlike(r"^\p{Nd}+\z") & (F.octet_length(t) <= 4)) | (dashed & (dashes >= 2) & (F.octet_length(t) < 20))


def numeric_entities(c: Column) -> Column:
    """Decimal and hexadecimal character references decoded; others, and those beyond Unicode, stay."""
    def one(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2], 16)
        return chr(n) if 0 < n < 0x10FFFF and not 0xD800 <= n < 0xE000 else m[0]

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.str.replace(r"&#(?:(\d+)|[xX]([0-9a-fA-F]+));", one, regex=True)

    return decode(c)


_HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}"
#: Punctuation beside which recognised text has stray blanks.
HAN_MARKS = "，。、；：？！\"'（）【】《》〔〕·—"


def without_han_spaces(c: Column, marks: bool = True) -> Column:
    """Without single blanks between Han characters, or a Han character and a digit or, with marks, punctuation.

    marks: as recognised images are cleaned; without, as OFD text is.
    """
    beside = f"{_HAN}0-9{HAN_MARKS if marks else ''}"
    return F.regexp_replace(c, f"(?<=[{_HAN}]) (?=[{beside}])|(?<=[{beside}]) (?=[{_HAN}])", "")
