"""Main text of web pages, with site templates removed.

First pass: a page's elements are found and each subtree is hashed, from its start tag, its texts and
the hashes of the elements within. Spark counts per host on how many pages, differing in their main
text, each subtree recurs (so copies of one article count once). Subtrees that recur on a large part of
a host's pages are its template. Second pass: a page joins its host's template hashes, and what lies in
such a subtree goes. Within article or main the template has to be on most of at least TIGHT_PAGES
pages, as paragraphs may recur there in their own right.

Elements that are never main text go by tag, role or hidden state, some by class or id, whatever recurs.
Names only help: an element goes by its name if that is all the name says (ad, left-sidebar, but not
has-sidebar or banner-story), and stays if it holds an article or main element or, where the page has
none, most of the page's paragraphs. Headers, related sections and widgets within an article are part of
it. The main text is what lies in article elements, else in main, else everything; not so if paragraphs
elsewhere hold more than twice as much, as beside a teaser. A page takes time in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .url_filter import host_of

PAGES, PART = 4, 0.3
TIGHT_PAGES, TIGHT_PART = 10, 0.6
BROADCAST = 4_000_000
SALTS = 16

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>\"']*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"""(?<![^\s"'/])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"(?<!\S)hidden(?=\s|$|=)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Never main text, whatever they hold; and unless they hold an article.
_DROP = _RAW | frozenset("head nav footer menu button select option svg canvas object audio video datalist".split())
_UNLESS_ARTICLE = frozenset("header aside dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_SUFFIX = r"(?:[-_]*(?:container|wrapper|wrap|box|bar|block|section|area|list|slot|unit|top|bottom|left|right|inner|outer|panel|form|links?|items?|thread|\d+))*"
_PREFIX = r"(?:(?:site|page|main|global|top|bottom|left|right|post|article|entry|blog|web|side|user|reader|primary|secondary|mobile|desktop|sticky|fixed|inline)[-_]+)*"
_ANYWHERE = re.compile(
    _PREFIX + r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|promotion|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|cookies?|consent|gdpr|notice|newsletter|subscribe|subscription|popup|modal|social|share|sharing|"
    r"comments?|replies|disqus|login|signup|pagination|pager)" + _SUFFIX, re.I,
)
_OUTSIDE = re.compile(_PREFIX + r"(?:header|masthead|related|recommended|widget)" + _SUFFIX, re.I)
_KEEP = frozenset(("html", "body", "main", "article"))
_PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd td".split())
#: An open element of the first kind is closed by a start tag of the second, but not across an element of the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_P_STAYS = {"article", "main", "div", "section", "td", "th", "li", "aside", "nav", "footer", "header", "form", "blockquote", "table", "body"}
STAY, DROP, UNLESS_ARTICLE, UNLESS_MOST = range(4)


class Element:
    __slots__ = ("tag", "up", "rule", "gone", "main", "article", "hash")

    def __init__(self, tag, up, rule, main, article, hash):
        self.tag, self.up, self.rule, self.gone, self.main, self.article, self.hash = tag, up, rule, False, main, article, hash


def _rule(tag: str, attrs: str, within: bool) -> tuple[int, str]:
    """When an element goes, and its role. within: it lies in article or main."""
    if tag in _DROP:
        return DROP, ""
    rule = UNLESS_MOST if tag == "form" else UNLESS_ARTICLE if tag in _UNLESS_ARTICLE and not (tag == "header" and within) else STAY
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return rule, ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    role = found.get("role", "").lower()
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    if tag in _KEEP:
        comment = tag == "article" and any("comment" in n.lower() and _ANYWHERE.fullmatch(n) for n in names)
        return UNLESS_ARTICLE if comment else STAY, role
    hidden = found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs) or "display:none" in found.get("style", "").replace(" ", "").lower()
    if rule == STAY and (role in _ROLES or hidden):
        return UNLESS_ARTICLE, role
    if rule == STAY and any(_ANYWHERE.fullmatch(n) or not within and _OUTSIDE.fullmatch(n) for n in names):
        return UNLESS_MOST, role
    return rule, role


class _Reader:
    """Reads one page: elements in page order, and text blocks (innermost open element or -1, text with single spaces)."""

    def __init__(self, page: str):
        self.page = page
        self.elements: list[Element] = []
        self.blocks: list[tuple[int, str]] = []
        self.stack: list[int] = []
        self.open: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.words: list[str] = []
        self.unquoted: set[str] = set()  # quotes that don't occur any more
        self.read()

    def flush(self) -> None:
        if self.words:
            text = " ".join(entities.unescape("".join(self.words)).split())
            self.words.clear()
            if text:
                self.blocks.append((self.stack[-1] if self.stack else -1, text))

    def close(self, k: int) -> None:
        """Close the stack from place k on."""
        if any(self.elements[i].tag in _BLOCK for i in self.stack[k:]):
            self.flush()
        while len(self.stack) > k:
            e = self.elements[self.stack.pop()]
            self.open[e.tag].pop()
            digest = e.hash.digest()
            e.hash = int.from_bytes(digest, "big", signed=True)
            if self.stack:
                self.elements[self.stack[-1]].hash.update(digest)

    def last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def text(self, piece: str) -> None:
        if piece and (self.words or not piece.isspace()):
            self.words.append(piece)
            if self.stack:
                self.elements[self.stack[-1]].hash.update(piece.encode("utf-8", "surrogatepass"))

    def tag_end(self, at: int) -> int:
        """Where the > of a tag is, which quoted values may hold too; -1: nowhere."""
        while m := _STOP.search(self.page, at):
            if not m[1]:
                return m.start()
            end = -1 if m[1] in self.unquoted else self.page.find(m[1], m.end())
            if end < 0:
                self.unquoted.add(m[1])
            at = max(end + 1, m.end())
        return -1

    def read(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            i = page.find("<", at)
            if i < 0:
                self.text(page[at:])
                break
            self.text(page[at:i])
            if page.startswith("<!--", i):
                at = page.find("-->", i + 4) + 3
                if at < 3:
                    break
                continue
            m = _SIMPLE.match(page, i) or _NAME.match(page, i)
            if not m:
                if page[i + 1 : i + 2] in ("!", "?"):
                    at = page.find(">", i) + 1
                    if not at:
                        break
                    continue
                self.text("<")
                at = i + 1
                continue
            if m.lastindex == 3:
                at, attrs = m.end(), m[3]
            else:
                end = self.tag_end(m.end())
                if end < 0:
                    break
                at, attrs = end + 1, page[m.end() : end]
            at = (self.end if m[1] else self.start)(m[2].lower(), attrs, at)
        self.close(0)
        self.flush()

    def end(self, tag: str, attrs: str, at: int) -> int:
        if self.open.get(tag):
            self.close(self.open[tag][-1])
        elif tag in ("p", "br"):
            self.flush()
        return at

    def start(self, tag: str, attrs: str, at: int) -> int:
        if tag in _BLOCK:
            if self.open.get("p") and (k := self.open["p"][-1]) > self.last(_P_STAYS):
                self.close(k)
            self.flush()
        if tag in _CLOSES:
            tags, stop = _CLOSES[tag]
            if (k := self.last(tags)) >= 0 and k > self.last(stop):
                self.close(k)
        up = self.elements[self.stack[-1]] if self.stack else None
        if tag in _VOID:
            self.words.append(" ")
            if up:
                up.hash.update(f"<{tag}{attrs}>".encode("utf-8", "surrogatepass"))
            return at
        rule, role = _rule(tag, attrs, bool(up and (up.main or up.article)))
        self.elements.append(Element(
            tag, self.stack[-1] if self.stack else -1, rule, tag == "main" or role == "main" or bool(up and up.main),
            tag == "article" or role == "article" or bool(up and up.article),
            xxhash.xxh64(f"<{tag}{attrs}>".encode("utf-8", "surrogatepass")),
        ))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.elements) - 1)
        if attrs.endswith("/") and tag in ("svg", "path"):
            self.close(len(self.stack) - 1)
        elif tag in _RAW:
            low = re.compile(rf"</{tag}\s*>", re.I).search(self.page, at)
            self.elements[-1].hash.update(self.page[at : low.start() if low else None].encode("utf-8", "surrogatepass"))
            at = low.end() if low else len(self.page)
            self.close(len(self.stack) - 1)
        return at


def parsed(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """Elements, those that are never main text marked as gone, and text blocks (innermost element or -1, text)."""
    read = _Reader(page)
    elements, blocks = read.elements, read.blocks
    n = len(elements)
    shut = [False] * n
    for i, e in enumerate(elements):
        shut[i] = e.rule == DROP or e.up >= 0 and shut[e.up]
    size, story = [0] * n, [False] * n  # characters in paragraphs; whether an article or main with text lies within
    total = 0
    for i, t in blocks:
        if i >= 0 and not shut[i]:
            story[i] = elements[i].main or elements[i].article
            if elements[i].tag in _PARAGRAPH:
                size[i] += len(t)
                total += len(t)
    for i in range(n - 1, -1, -1):
        e, up = elements[i], elements[i].up
        if up >= 0:
            size[up] += size[i]
            # an article that is a comment is none, and what lies within an article passes on no more than the article does
            story[up] = story[up] or story[i] and e.rule != UNLESS_ARTICLE
    any_story = any(s and e.tag in ("main", "article") and e.rule == STAY for s, e in zip(story, elements))
    for i, e in enumerate(elements):
        up = elements[e.up] if e.up >= 0 else None
        around = not (up and (up.main or up.article)) and not e.main and not e.article
        holds = around and story[i]
        most = not any_story and 2 * size[i] > total
        e.gone = bool(up and up.gone) or e.rule == DROP or e.rule == UNLESS_ARTICLE and not holds or e.rule == UNLESS_MOST and not (holds or most)
    return elements, blocks


def region(elements: list[Element], blocks: list[tuple[int, str]]) -> str:
    """Where the main text is: 'article', 'main' or 'body' (everything)."""
    left = [(elements[i], len(t)) for i, t in blocks if i >= 0 and not elements[i].gone]
    for where in ("article", "main"):
        within = sum(n for e, n in left if _inside(e, where))
        beside = sum(n for e, n in left if not _inside(e, where) and e.tag in _PARAGRAPH)
        if within and beside <= 2 * within:
            return where
    return "body"


def _inside(e: Element, where: str) -> bool:
    return e.article if where == "article" else e.main if where == "main" else True


def extract(page: str, loose: frozenset | set = frozenset(), tight: frozenset | set = frozenset()) -> str:
    """The main text, without subtrees whose hash is in loose (tight, within article or main)."""
    elements, blocks = parsed(page)
    for e in elements:
        e.gone = e.gone or e.up >= 0 and elements[e.up].gone or (
            e.tag in _BLOCK and e.tag not in _KEEP and e.hash in (tight if e.article or e.main else loose))
    where = region(elements, blocks)
    return "\n".join(t for i, t in blocks if (i < 0 and where == "body") or (i >= 0 and not elements[i].gone and _inside(elements[i], where)))


def subtrees(page: str) -> tuple[int, list[int], list[int]]:
    """Hash of the main text; hashes of the block subtrees outside and inside article or main."""
    elements, blocks = parsed(page)
    where = region(elements, blocks)
    text = "\n".join(t for i, t in blocks if i >= 0 and not elements[i].gone and _inside(elements[i], where))
    main = int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass")), "big", signed=True)
    outside, inside = set(), set()
    for e in elements:
        if not e.gone and e.tag in _BLOCK and e.tag not in _KEEP:
            (inside if e.article or e.main else outside).add(e.hash)
    return main, sorted(outside), sorted(inside)


def templates(pages: DataFrame, host_col: str = "host", html_col: str = "html") -> DataFrame:
    """(host, loose, tight): each host's recurring subtrees, as arrays of hashes."""
    src = pages.select(F.col(host_col).alias("host"), common.text_of(html_col).alias("html"))

    def run(batches):
        for b in batches:
            found = [subtrees(h.as_py()) for h in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([f[0] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.int64())),
            ], names=["host", "main", "outside", "inside"])

    seen = common.written(src.mapInArrow(run, "host string, main long, outside array<long>, inside array<long>"))
    pages_of = seen.groupBy("host", "main").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    pages_of = pages_of.where(F.col("pages") >= min(PAGES, TIGHT_PAGES))
    parts = [seen.select("host", "main", F.lit(k == "inside").alias("inside"), F.explode(k).alias("hash")) for k in ("outside", "inside")]
    each = parts[0].unionByName(parts[1]).groupBy("host", "inside", "hash", "main").agg(F.lit(1).alias("one"))
    counts = each.groupBy("host", "inside", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min(PAGES, TIGHT_PAGES))
    often = counts.join(pages_of, "host").where(
        F.when(F.col("inside"), (F.col("n") >= TIGHT_PAGES) & (F.col("n") >= TIGHT_PART * F.col("pages"))).otherwise(
            (F.col("n") >= PAGES) & (F.col("n") >= PART * F.col("pages")))
    )
    return often.groupBy("host").agg(
        F.collect_list(F.when(~F.col("inside"), F.col("hash"))).alias("loose"), F.collect_list(F.when(F.col("inside"), F.col("hash"))).alias("tight")
    )


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id_col, url_col, text, n_chars (code points).

    Null html counts as empty; a page without main text has an empty text and 0. Null urls share the
    empty host. Repeated rows stay; other columns are ignored.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), common.text_of(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    known = common.written(templates(src))
    hashes = known.agg(F.sum(F.size("loose") + F.size("tight")).alias("n")).first()["n"] or 0
    if hashes <= BROADCAST:  # so pages stay where they are
        joined = src.join(F.broadcast(known), "host", "left")
    else:  # a host's pages go to SALTS tasks or more, each with its templates
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = src.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")
    joined = joined.select("id", "url", "html", "loose", "tight")

    def run(batches):
        for b in batches:
            texts = []
            for page, loose, tight in zip(b.column(2), b.column(3), b.column(4)):
                texts.append(extract(page.as_py(), frozenset(loose.as_py() or ()), frozenset(tight.as_py() or ())))
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())
            ], names=["id", "url", "text", "n_chars"])

    kind = dict(src.dtypes)["id"]
    out = joined.mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    Null html is an empty page: text '' and 0. A null url is of the empty host. Repeated rows stay, and
    equal pages of a host have equal texts; an empty table gives no rows; other columns are ignored.
    """
    return main_text(common.table(spark, sf_dir, "pages"))
