"""The same expressions in DuckDB SQL, made from the same rule packs, to hold queries against."""

from __future__ import annotations

from ..functions.text import ENTITIES, SPACES
from ..operators import score as sc
from .packs import KEYWORD_ORDER, PATTERN_ORDER, Pack


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{SPACES}]+|[{SPACES}]+$')}, '', 'g')"


def lf(x: str) -> str:
    return f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def preprocess(x: str) -> str:
    return f"regexp_replace({lf(trim(x))}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def cut_bytes(x: str, n: int) -> str:
    fit = f"length(decode(encode({x})[1:{n}], 'replace'))"
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} WHEN strlen(left({x}, {fit})) <= {n} THEN left({x}, {fit}) ELSE left({x}, {fit} - 1) END"


def page_marker(x: str) -> str:
    t, dashes = trim(x), "-\u2010\u2011\u2013\u2014\u2212"
    count = f"(length({t}) - length(translate({t}, '{dashes}', '')))"
    return f"(regexp_full_match({t}, '\\p{{Nd}}+') AND strlen({t}) <= 4 OR regexp_full_match({t}, '[\\p{{Nd}} \\{dashes}]+') AND regexp_matches({t}, '\\p{{Nd}}') AND {count} >= 2 AND strlen({t}) < 20)"


def line_text(x: str) -> str:
    plain = f"regexp_extract_all(regexp_replace({x}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '[ \\t]+|[^ \\t]+')"
    letters = "regexp_matches(coalesce(p[i - 1], ''), '[A-Za-z]$') AND regexp_matches(coalesce(p[i + 1], ''), '^[A-Za-z]')"
    spaced = f"(SELECT array_to_string(list_transform(p, lambda w, i: CASE WHEN NOT regexp_matches(w, '^[ \\t]') THEN w WHEN {letters} THEN replace(w, chr(9), ' ') ELSE '' END), '') FROM (SELECT {plain} AS p))"
    ended = f"regexp_replace(regexp_replace(replace({spaced}, chr(13), chr(10)), '([。！？])', '\\1\n', 'g'), '([。！？])\n([”“’‘\"''》〉\n])', '\\1\\2', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({ended}, chr(10)), lambda l: {trim('l')}), lambda l: l <> '' AND NOT {page_marker('l')}), chr(10))"


def normalize_whitespace(x: str) -> str:
    lines = f"array_to_string(list_transform(string_split({lf(x)}, chr(10)), lambda l: {trim('l')}), chr(10))"
    return trim(f"regexp_replace(regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')")


def entities(x: str) -> str:
    for name, text in ENTITIES:
        x = f"replace({x}, {q(name)}, {q(text)})"
    return x


def strip_html(x: str) -> str:
    return entities(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")


def strip_xml(x: str) -> str:
    x = f"regexp_replace({x}, '<\\?xml[^?]*\\?>', '', 'g')"
    x = f"regexp_replace({x}, '<!\\[CDATA\\[(.*?)\\]\\]>', '\\1', 'g')"
    return f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"


def first(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def level(word: str, pack: Pack) -> str:
    return "CASE " + " ".join(f"WHEN {word} = {q(w)} THEN {n}" for w, n in pack.levels) + " ELSE 0 END"


def matched(low: str, words: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(map(q, words))}], lambda w: contains({low}, lower(w)))"


def byte_scan(hexa: str, pack: Pack) -> tuple[str, str]:
    """Over hex(content): labels and levels of the first byte word on a byte boundary."""
    test = lambda form: f"regexp_matches({hexa}, '^(..)*?{form}')"
    label = "CASE " + " ".join(f"WHEN {test(f)} THEN {q(n)}" for n, _, _, f in pack.byte_words) + " ELSE '' END"
    return label, "CASE " + " ".join(f"WHEN {test(f)} THEN {v}" for _, _, v, f in pack.byte_words) + " ELSE 0 END"


def _copy_number(pack: Pack) -> str:
    gap = f"[{SPACES}]*"
    l = "l"  # noqa: E741
    got = [first(l, "^([0-9]{6})$", 1), first(l, f"^第{gap}([0-9]{{6}}){gap}号$", 1)]
    for w in pack.copy_words:
        rest = f"substr({l}, position({q(w)} IN {l}) + {len(w)})"
        got.append(f"CASE WHEN contains({l}, {q(w)}) THEN {first(rest, f'^{gap}[：: ]*([0-9]{{6}})', 1)} ELSE '' END")
    got.append(first(l, "^([0-9]{6})(?:[^0-9]|$)", 1))
    of = "coalesce(" + ", ".join(f"nullif({g}, '')" for g in got) + ", '')"
    lines = f"list_transform(list_transform(string_split(t, chr(10))[1:10], lambda r: {trim('r')}), lambda l: {of})"
    return f"coalesce(list_filter({lines}, lambda c: c <> '')[1], '')"


def facts(source: str, text: str, pack: Pack, keep: str) -> str:
    """SELECT of keep and the columns of features.facts() from a table."""
    p = lambda n: trim(first("t", pack.patterns[n]))
    either = lambda a, b: f"CASE WHEN {p(a)} <> '' THEN {p(a)} ELSE {p(b)} END"
    im = p("issuer")
    issuer = f"CASE WHEN contains({im}, ':') THEN {trim(f'substr({im}, position(chr(58) IN {im}) + 1)')} WHEN contains({im}, '：') THEN {trim(f'substr({im}, position({q(chr(0xff1a))} IN {im}) + 1)')} ELSE '' END"
    cols = [
        f"{_copy_number(pack)} AS copy_number", f"{either('doc_number_full', 'doc_number')} AS doc_number", f"{p('title')} AS title",
        f"{p('secret_level')} AS secret_level", f"{p('urgency')} AS urgency", f"{issuer} AS issuer", f"{p('main_send')} AS main_send",
        f"{either('issue_date', 'issue_date_numeric')} AS issue_date", f"{p('copy_to')} AS copy_to", f"{p('attachment')} AS attachment",
        f"{p('print_info')} AS print_info", "strlen(raw) AS text_length",
    ] + [f"{matched('low', pack.keywords[k])} AS {k}" for k in KEYWORD_ORDER]
    names = [c.rsplit(" AS ", 1)[1] for c in cols]
    kept = ", ".join(k.rsplit(" AS ", 1)[-1].strip() for k in keep.split(","))
    inner = f"SELECT {keep}, coalesce({text}, '') AS raw, {preprocess(f'coalesce({text}, {q(str())})')} AS t FROM {source}"
    found = " + ".join(f"({n} <> '')::INT" for n in names[:11])
    words = " + ".join(f"len({k})" for k in KEYWORD_ORDER[:-1])
    return f"""SELECT *, {found} AS pattern_matches, {words} AS keyword_matches, {found} + (len(org) > 0)::INT AS positive_count,
      ((doc_number <> '')::INT + (title <> '')::INT + (issue_date <> '')::INT) >= 2 AS has_critical,
      CASE WHEN {words} = 0 THEN 0.0::DOUBLE ELSE len(prohibited)::DOUBLE / ({words} + len(prohibited)) END AS prohibited_ratio
      FROM (SELECT *, {trim(first('title', pack.patterns['title_type']))} AS title_type FROM (
        SELECT {kept}, {', '.join(cols)} FROM (SELECT *, lower(t) AS low FROM ({inner}))))"""


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def text_score(w: sc.Weights = sc.DEFAULT) -> str:
    parts = ["0.0::DOUBLE"]
    for name, v in w.text.items():
        if name == "org":
            parts.append(f"CASE WHEN len(org) > 3 THEN {_d(v)} * {_d(1.2)} WHEN len(org) > 0 THEN {_d(v)} ELSE 0.0::DOUBLE END")
        elif name == "prohibited":
            parts.append(f"CASE WHEN len(prohibited) > 0 THEN -({_d(v)} * least(len(prohibited) / {_d(5.0)}, {_d(1.0)})) ELSE 0.0::DOUBLE END")
        elif name in ("doctype", "action", "formal", "header", "footer"):
            parts.append(f"CASE WHEN len({name}) > 0 THEN {_d(v)} * least(len({name}), 3)::DOUBLE / {_d(3.0)} ELSE 0.0::DOUBLE END")
        else:
            cond = "title <> '' AND title_type <> ''" if name == "title_type" else f"{name} <> ''"
            parts.append(f"CASE WHEN {cond} THEN {_d(v)} ELSE 0.0::DOUBLE END")
    total = parts[0]
    for p in parts[1:]:
        total = f"({total} + {p})"
    return clamp(total)


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def style_score(w: sc.Weights = sc.DEFAULT) -> str:
    total = "0.0::DOUBLE"
    for f, v in w.style.items():
        total = f"({total} + CASE WHEN {f} THEN {_d(v)} ELSE 0.0::DOUBLE END)"
    return f"least({total}, 1.0::DOUBLE)"


def adjusted(total: str, style: bool) -> str:
    give = lambda cond, v: f"CASE WHEN {cond} THEN {_d(v)} ELSE 0.0::DOUBLE END"
    parts = [
        f"CASE WHEN text_length < 100 THEN {_d(-0.15)} WHEN text_length < 200 THEN {_d(-0.08)} ELSE 0.0::DOUBLE END",
        give("doc_number <> '' AND title <> '' AND issue_date <> ''", 0.06), give("copy_number <> '' AND doc_number <> ''", 0.03),
    ]
    if style:
        red, seal, a4, image = "has_red_header", "has_seal_image", "is_a4_paper", "is_image"
        parts += [
            give(f"{red} AND {seal}", 0.08), give(f"{red} AND has_red_text AND {a4}", 0.05),
            f"CASE WHEN {image} AND {red} AND {seal} AND {a4} THEN {_d(0.15)} WHEN {image} AND {red} AND {seal} THEN {_d(0.10)} WHEN {image} AND {red} AND {a4} THEN {_d(0.06)} ELSE 0.0::DOUBLE END",
            give(f"{image} AND text_length < 200 AND text_length >= 50", 0.05), give(f"doc_number <> '' AND {red}", 0.05),
        ]
    for p in parts:
        total = f"({total} + {p})"
    return clamp(total)


def confidence(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {_d(v)} THEN {q(n)}" for v, n in sc.BANDS) + f" ELSE {q(sc.LOWEST)} END"


def pattern_rows(source: str, text: str, pack: Pack, keep: str) -> str:
    each = " UNION ALL ".join(f"SELECT {keep}, {q(n)} AS pattern, {first(text, pack.patterns[n])} AS matched FROM {source}" for n in PATTERN_ORDER)
    return f"SELECT * FROM ({each}) WHERE matched <> ''"
