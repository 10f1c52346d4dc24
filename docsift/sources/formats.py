"""Text and layout facts of file formats, a row per file, in Arrow batches.

Formats are small functions bytes -> text over the standard library; Spark deals the files out. A file
that cannot be read gives its error and no text, never a failed task.
"""

from __future__ import annotations

import io
import quopri
import re
import zipfile
from email import policy as email_policy
from email.parser import BytesParser
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFICE_LIMIT, OFD_LIMIT, OFD_MEMBERS = 20 << 10, 10 << 10, 10
# Members and tags that carry electronic classification marks.
TAG_MEMBERS = ("docProps/custom.xml", "docProps/core.xml", "OFD.xml")
TAGS = ("机密", "绝密", "SecretLevel", "秘密")
_BLOCKS = frozenset("p div br h1 h2 h3 h4 h5 h6 li tr table ul ol section article header footer title".split())


def decode(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else GBK, else UTF-8 with replacements."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    for codec in ("utf-8", "gbk"):
        try:
            return data.decode(codec)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def tidy(text: str) -> str:
    """LF line ends, trimmed lines, one blank in a row, one empty line in a row."""
    lines = [re.sub(r"[ \t]+", " ", line).strip() for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class _Html(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip() + " ")


def html_text(data: bytes) -> str:
    p = _Html()
    p.feed(decode(data))
    p.close()
    return tidy("".join(p.out))


def xml_text(data: bytes) -> str:
    t = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", re.sub(r"<\?xml[^?]*\?>", "", decode(data)))
    return tidy(re.sub(r"<[^>]*>", " ", t))


def rtf_text(data: bytes) -> str:
    """Plain text of RTF: groups of fonts, colours and pictures skipped, escaped bytes read as GBK."""
    out, depth, skip, raw = [], 0, None, bytearray()
    token = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")

    def flush():
        if raw:
            out.append(bytes(raw).decode("gbk", "replace"))
            raw.clear()

    for m in token.finditer(data):
        code, word, number, sign, brace, text = m.groups()
        if brace:
            depth += 1 if brace == b"{" else -1
            if skip is not None and depth < skip:
                skip = None
        elif skip is not None:
            continue
        elif code:
            raw.append(int(code, 16))
        elif word:
            if word in (b"fonttbl", b"colortbl", b"stylesheet", b"pict", b"info"):
                skip = depth
            elif word in (b"par", b"line", b"tab"):
                flush()
                out.append("\t" if word == b"tab" else "\n")
            elif word == b"u" and number:
                flush()
                out.append(chr(int(number) % 65536))
        elif sign == b"*":
            skip = depth
        elif sign in (b"\\",):
            raw += sign
        elif text:
            flush()
            out.append(text.decode("latin-1"))
    flush()
    return tidy("".join(out))


def eml_text(data: bytes) -> str:
    """The body of a mail, its text part or its html part stripped."""
    m = BytesParser(policy=email_policy.default).parsebytes(data)
    part = m.get_body(preferencelist=("plain", "html"))
    if part is None:
        return tidy(decode(quopri.decodestring(data.partition(b"\n\n")[2])))
    body = part.get_content()
    return html_text(body.encode()) if part.get_content_type() == "text/html" else tidy(body)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_text(data: bytes) -> str:
    """Headers, body and footers: paragraphs and breaks as LF, tabs as TAB."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        members = sorted(n for n in names if re.fullmatch(r"word/header\d*\.xml", n)) + ["word/document.xml"] * ("word/document.xml" in names)
        members += sorted(n for n in names if re.fullmatch(r"word/footer\d*\.xml", n))
        out = []
        for n in members:
            for event, e in ElementTree.iterparse(z.open(n), events=("end",)):
                tag = _local(e.tag)
                if tag == "t":
                    out.append(e.text or "")
                elif tag in ("p", "br"):
                    out.append("\n")
                elif tag == "tab":
                    out.append("\t")
    return tidy("".join(out))


def ofd_text(data: bytes) -> str:
    """Text codes of all pages in order of their number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages = [n for n in z.namelist() if n.endswith("Content.xml")]
        number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
        out = []
        for n in sorted(pages, key=number):
            out += [e.text or "" for e in ElementTree.parse(z.open(n)).iter() if _local(e.tag) == "TextCode"] + ["\n"]
    return tidy("\n".join(out))


def zip_members(data: bytes, pattern: str, limit: int, most: int | None = None) -> list[tuple[str, bytes]]:
    """(name, first bytes) of the members whose name matches, until limit bytes are read."""
    out, left = [], limit
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for n in z.namelist():
            if left <= 0 or most is not None and len(out) >= most:
                break
            if re.search(pattern, n):
                with z.open(n) as f:
                    part = f.read(left)
                out.append((n, part))
                left -= len(part)
    return out


def limited_text(data: bytes, ofd: bool = False) -> str:
    """Character data of an office package's (OFD's) XML members, read only as far as the marker scan does."""
    parts = zip_members(data, r"Content\.xml$" if ofd else r"\.xml$", OFD_LIMIT if ofd else OFFICE_LIMIT, OFD_MEMBERS if ofd else None)
    return " ".join(re.sub(r"<[^>]*>", " ", p.decode("utf-8", "replace")) for _, p in parts)


def metadata_tags(data: bytes) -> list[tuple[str, str]]:
    """(member, tag) of classification tags in a package's property members, each once."""
    found = zip_members(data, "|".join(re.escape(m) + "$" for m in TAG_MEMBERS), 1 << 20)
    return sorted({(n, t) for n, part in found for t in TAGS if t.encode() in part})


def pdf_text(data: bytes) -> str:
    """The text of a PDF's pages in order, LF between pages that have any."""
    from .pdf import page_texts

    return tidy("\n".join(p for p in page_texts(data) if p))


def doc_text(data: bytes) -> str:
    """Readable runs of an OLE2 document: UTF-16LE runs of Han or ASCII, or else ASCII runs; lines once."""
    wide = re.findall(rb"(?:[\x20-\x7e\x09\x0a\x0d]\x00|[\x00-\xff][\x4e-\x9f]|[\x00-\xff][\x30\xff]){4,}", data)
    runs = [r.decode("utf-16-le", "replace") for r in wide] or [r.decode("ascii") for r in re.findall(rb"[\x20-\x7e\x09\x0a\x0d]{6,}", data)]
    lines = dict.fromkeys(line.strip() for r in runs for line in re.split(r"[\r\n]+", r))
    return tidy("\n".join(line for line in lines if len(line) >= 2))


READERS = {
    "txt": lambda b: tidy(decode(b)), "text": lambda b: tidy(decode(b)), "html": html_text, "htm": html_text, "mht": html_text, "mhtml": html_text,
    "xml": xml_text, "rtf": rtf_text, "eml": eml_text, "docx": docx_text, "docm": docx_text, "dotx": docx_text, "dotm": docx_text,
    "ofd": ofd_text, "pdf": pdf_text, "doc": doc_text, "wps": doc_text, "wpt": doc_text,
}


def extracted(files: DataFrame, kind: str = "ext", content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, text and error of every file, by its kind; kinds without a reader have an error."""
    src = files.select(*keep, F.col(kind).alias("_kind"), F.col(content).alias("_content"))

    def run(batches):
        for b in batches:
            texts, errors = [], []
            for k, c in zip(b.column(len(keep)), b.column(len(keep) + 1)):
                text, error = None, None
                try:
                    text = READERS[k.as_py()](c.as_py() or b"")
                except KeyError:
                    error = f"no reader for {k.as_py()}"
                except Exception as e:  # noqa: BLE001  a broken file is a result, not a failure
                    error = f"{type(e).__name__}: {e}"[:200]
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*keep, "text", "error"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], "text string", "error string"]))


def tag_hits(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, member and tag of every classification tag in packages; other files have none."""
    src = files.where(F.startswith(F.col(content), F.lit(b"PK"))).select(*keep, F.col(content).alias("_content"))

    def run(batches):
        for b in batches:
            rows = []
            for i, c in enumerate(b.column(len(keep))):
                try:
                    rows += [(i, m, t) for m, t in metadata_tags(c.as_py())]
                except zipfile.BadZipFile:
                    continue
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[: len(keep)]], pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[*keep, "member", "tag"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keep], "member string", "tag string"]))


def docx_style(data: bytes) -> dict:
    """Layout facts of a DOCX: colours, fonts, sizes, page, margins, centred title, spacing, picture."""
    from ..operators import style as st

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        body = ElementTree.fromstring(z.read("word/document.xml"))
    red = lambda c: bool(re.fullmatch(r"[0-9A-Fa-f]{6}", c)) and int(c[:2], 16) >= 180 and int(c[2:4], 16) <= 80 and int(c[4:], 16) <= 80
    facts = dict.fromkeys(("has_red_text", "has_red_header", "has_official_fonts", "title_font_match", "body_font_match", "is_a4_paper", "margin_match", "has_centered_title", "line_spacing_match"), False)
    for i, p in enumerate(body.iter(f"{w}p")):
        centred = any(j.get(f"{w}val") == "center" for j in p.iter(f"{w}jc"))
        facts["has_centered_title"] |= centred and i < 10
        facts["line_spacing_match"] |= any(abs(float(s.get(f"{w}line", 0)) / 20 - st.LINE_SPACING) <= 2 for s in p.iter(f"{w}spacing"))
        for r in p.iter(f"{w}r"):
            if any(red(c.get(f"{w}val", "")) for c in r.iter(f"{w}color")):
                facts["has_red_text"] = True
                facts["has_red_header"] |= i < 3
            fonts = " ".join(v for f in r.iter(f"{w}rFonts") for v in f.attrib.values())
            facts["has_official_fonts"] |= any(n in fonts for n in ("仿宋", "小标宋", "楷体", "黑体"))
            size = [float(s.get(f"{w}val", 0)) / 2 for s in r.iter(f"{w}sz")]
            bold = next(r.iter(f"{w}b"), None) is not None
            facts["title_font_match"] |= bold and any(abs(s - st.TITLE_SIZE) <= 0.5 for s in size)
            facts["body_font_match"] |= any(abs(s - st.BODY_SIZE) <= 0.5 for s in size)
    mm = lambda v: float(v or 0) / st.TWIPS_PER_PT * st.MM_PER_PT
    for s in body.iter(f"{w}pgSz"):
        facts["is_a4_paper"] |= abs(mm(s.get(f"{w}w")) - st.A4[0]) <= 2 and abs(mm(s.get(f"{w}h")) - st.A4[1]) <= 2
    for s in body.iter(f"{w}pgMar"):
        facts["margin_match"] |= all(abs(mm(s.get(f"{w}{k}")) - v) <= st.MARGIN_TOLERANCE for k, v in st.MARGINS.items())
    facts["has_seal_image"] = any(re.match(r"word/media/.*(?:seal|stamp|sign)", n, re.I) for n in names)
    return facts
