"""Facts of a text by a rule pack: patterns, keyword sets, lengths and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import once
from ..functions.regex import to_java
from ..functions.text import SPACES, preprocess, trim
from ..plans.packs import KEYWORD_ORDER, PATTERN_ORDER, Pack
from .keywords import matched

FACTS = (
    "copy_number", "doc_number", "title", "title_type", "secret_level", "urgency", "issuer", "main_send", "issue_date", "copy_to", "attachment",
    "print_info",
)
LINES = 10


def first(text: Column, pack: Pack, name: str) -> Column:
    """The first match of a named pattern; '' if none. Texts without what every match holds are not searched."""
    found = F.regexp_extract(text, to_java(pack.patterns[name]), 0)
    return F.when(F.contains(text, F.lit(pack.needs[name])), found).otherwise("") if name in pack.needs else found


def copy_number(text: Column, pack: Pack) -> Column:
    """The 6-digit copy number of the first 10 lines; '' if none.

    A line gives it bare, between 第 and 号, after a copy word, or as its start before no further digit.
    """
    gap = rf"[{SPACES}]*"

    def of(t: Column) -> Column:
        got = [F.regexp_extract(t, r"^([0-9]{6})\z", 1), F.regexp_extract(t, rf"^第{gap}([0-9]{{6}}){gap}号\z", 1)]
        for w in pack.copy_words:
            rest = F.substr(t, F.locate(w, t) + len(w))
            got.append(F.when(F.contains(t, F.lit(w)), F.regexp_extract(rest, rf"^{gap}[：: ]*([0-9]{{6}})", 1)).otherwise(""))
        got.append(F.regexp_extract(t, r"^([0-9]{6})(?:[^0-9]|\z)", 1))
        return F.coalesce(*[F.nullif(g, F.lit("")) for g in got], F.lit(""))

    lines = F.filter(F.transform(F.slice(F.split(text, "\n", LINES + 1), 1, LINES), trim), lambda x: x.rlike("[0-9]{6}"))
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines, of), lambda x: x != ""), F.lit(1)), F.lit(""))


def issuer(text: Column, pack: Pack) -> Column:
    """What follows the colon of an issuer mark; '' without a mark or a colon."""
    m = trim(first(text, pack, "issuer"))
    at = F.when(F.contains(m, F.lit(":")), F.locate(":", m)).otherwise(F.locate("：", m))
    return F.when(at > 0, trim(F.substr(m, at + 1))).otherwise("")


def facts(df: DataFrame, text: str, pack: Pack) -> DataFrame:
    """df with FACTS, text_length (bytes), han_count, one array per keyword set, and derived counts.

    The text is preprocessed once; patterns see that form, lengths the raw one. Null is an empty text.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    d = once(df, {"_t": preprocess(raw)})
    d = once(d, {"_low": F.lower("_t")})
    t = F.col("_t")
    pat = lambda name: trim(first(t, pack, name))
    or_else = lambda a, b: F.coalesce(F.nullif(pat(a), F.lit("")), pat(b))
    d = once(d, {
        "copy_number": copy_number(t, pack), "doc_number": or_else("doc_number_full", "doc_number"), "title": pat("title"),
        "secret_level": pat("secret_level"), "urgency": pat("urgency"), "issuer": issuer(t, pack), "main_send": pat("main_send"),
        "issue_date": or_else("issue_date", "issue_date_numeric"), "copy_to": pat("copy_to"), "attachment": pat("attachment"),
        "print_info": pat("print_info"), "text_length": F.octet_length(raw), "han_count": F.regexp_count(raw, F.lit(r"[\x{4E00}-\x{9FFF}]")),
        **{k: matched(F.col("_low"), pack.keywords[k]) for k in KEYWORD_ORDER},
    })
    d = d.withColumn("title_type", trim(F.regexp_extract("title", to_java(pack.patterns["title_type"]), 0)))
    size = lambda k: F.size(k)
    patterns = [f for f in FACTS if f != "title_type"]
    words = sum((size(k) for k in KEYWORD_ORDER[1:-1]), size(KEYWORD_ORDER[0]))
    has = lambda f: (F.col(f) != "").cast("int")
    found = sum((has(f) for f in patterns[1:]), has(patterns[0]))
    return d.withColumns({
        "pattern_matches": found, "keyword_matches": words, "positive_count": found + (size("org") > 0).cast("int"),
        "has_critical": has("doc_number") + has("title") + has("issue_date") >= 2,
        "prohibited_ratio": F.when(words == 0, 0.0).otherwise(size("prohibited") / (words + size("prohibited"))),
        "recommended": found + (size("org") > 0).cast("int") >= 3,
    }).drop("_t", "_low")


# Names of the summary, with the fact behind each.
SUMMARY = (
    ("has_copy_number", "copy_number"), ("has_doc_number", "doc_number"), ("has_secret_level", "secret_level"), ("has_urgency_level", "urgency"),
    ("has_issuer", "issuer"), ("has_title", "title"), ("has_main_send", "main_send"), ("has_attachment", "attachment"),
    ("has_issue_date", "issue_date"), ("has_copy_to", "copy_to"), ("has_print_info", "print_info"),
)


def summary() -> Column:
    """The map of names to values, as text, that sums up the columns of facts()."""
    had = [(n, F.col(f) != "") for n, f in SUMMARY]
    counts = [
        ("title_type", F.col("title_type")), ("has_org_name", F.size("org") > 0), ("org_count", F.size("org")),
        ("pattern_matches", F.col("pattern_matches")), ("keyword_matches", F.col("keyword_matches")), ("prohibit_words_count", F.size("prohibited")),
    ]
    return F.create_map(*[x for n, c in had + counts for x in (F.lit(n), c.cast("string"))])


def pattern_rows(df: DataFrame, text: Column, pack: Pack, keep: list[str]) -> DataFrame:
    """keep and a row per pattern with a match: pattern, matched."""
    one = lambda n: F.struct(F.lit(n).alias("pattern"), first(text, pack, n).alias("matched"))
    return df.select(*keep, F.explode(F.array(*[one(n) for n in PATTERN_ORDER])).alias("p")).where("p.matched <> ''").select(*keep, "p.pattern", "p.matched")


def quick_check(text: Column, pack: Pack) -> Column:
    """At least 100 bytes, and 2 of: number, title, date, an organisation, a document type."""
    low = F.lower(text)
    signs = [first(text, pack, n) != "" for n in ("doc_number", "title", "issue_date")] + [F.size(matched(low, pack.keywords[k])) > 0 for k in ("org", "doctype")]
    return (F.octet_length(text) >= 100) & (sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2)
