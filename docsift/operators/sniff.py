"""Content types from bytes: magic numbers, then content, then the file name's extension.

All are Column expressions over a binary column; a header is a prefix of it. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT = 257  # the marker path pads heads to 261 bytes with NUL, so shorter texts look binary

# Magic numbers (hexadecimal), in the order in which they are tried, with the extension.
MAGIC = (
    ("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("526172211A0700", "rar"), ("526172211A070100", "rar"),
    ("377ABCAF271C", "7z"), ("1F8B", "gz"), ("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"),
    ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("52494646", "webp"), ("7B5C727466", "rtf"), ("D0CF11E0A1B11AE1", "doc"),
)
# Extensions by category, and their MIME types.
CATEGORIES = {
    "text": ("txt", "text", "html", "htm", "xml", "rtf", "mht", "mhtml", "eml"),
    "document": ("doc", "docx", "docm", "dotx", "dotm", "wps", "wpt"),
    "pdf": ("pdf",),
    "ofd": ("ofd",),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp"),
    "archive": ("zip", "rar", "7z", "gz", "tar"),
}
MIME = {
    "txt": "text/plain", "text": "text/plain", "html": "text/html", "htm": "text/html", "xml": "application/xml", "rtf": "application/rtf",
    "mht": "message/rfc822", "mhtml": "message/rfc822", "eml": "message/rfc822", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroEnabled.12",
    "dotx": "application/vnd.openxmlformats-officedocument.wordprocessingml.template", "dotm": "application/vnd.ms-word.template.macroEnabled.12",
    "wps": "application/vnd.ms-works", "wpt": "application/vnd.ms-works", "pdf": "application/pdf", "ofd": "application/ofd",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff",
    "webp": "image/webp", "zip": "application/zip", "rar": "application/x-rar-compressed", "7z": "application/x-7z-compressed",
    "gz": "application/gzip", "tar": "application/x-tar",
}
# Signs of HTML, and header lines of mails.
HTML_SIGNS = ("<html", "<head", "<body", "<title", "<meta", "<link", "<script", "<style", "<div", "<span", "<table", "<form")
MAIL_HEADERS = ("from:", "to:", "subject:", "date:", "message-id:")
SUPPORTED = ("text", "document", "pdf", "ofd", "image")
UNSUPPORTED_REASONS = {"image": "图片文件需要OCR识别，请确保已安装Tesseract", "archive": "压缩文件，请先解压后检测", "other": "未知或不支持的文件格式"}


def _starts(b: Column, form: str) -> Column:
    return F.startswith(b, F.lit(bytes.fromhex(form)))


def _text(b: Column) -> Column:
    """Bytes as Latin-1 characters, so that byte classes can be matched."""
    return F.decode(b, "ISO-8859-1")


def _has(text: Column, *words: str) -> list[Column]:
    return [F.contains(text, F.lit(w)) for w in words]


def _count(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def marker_type(content: Column, compat: bool = True) -> Column:
    """office, pdf, binary, image, text or unknown: what the marker scan tells apart.

    compat: texts under 257 bytes (260 with a byte-order mark) count as binary.
    """
    n, head = F.octet_length(content), F.substring(content, 1, 261)
    bom = _starts(head, "EFBBBF")
    plain = ~F.substring(_text(head), F.when(bom, 4).otherwise(1), F.lit(SHORT)).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    if compat:
        plain = plain & (n >= F.when(bom, SHORT + 3).otherwise(SHORT))
    image = _any([_starts(head, m) for m in ("FFD8FF", "89504E47", "47494638", "424D", "49492A00", "4D4D002A")])
    return (
        F.when(n < (0 if compat else 5), "unknown").when(_starts(head, "504B0304"), "office").when(_starts(head, "255044462D"), "pdf")
        .when(_starts(head, "7B5C727466") | _starts(head, "D0CF11E0"), "binary").when(image, "image").when(plain, "text").otherwise("binary")
    )


# Heads by the kind that a detector is given, in the order in which kinds are tried.
DETECTOR_HEADS = (
    ("image", ("FFD8FF", "89504E47", "474946", "424D", "49492A00", "4D4D002A", "38425053", "00000100")),
    ("archive", (
        "504B0304", "504B0506", "504B0708", "526172211A07", "377ABCAF271C", "1F8B08", "425A68", "FD377A585A00", "28B52FFD", "25504446", "4D5A",
        "7B5C727466", "7F454C46", "53514C69",
    )),
    ("document", ("D0CF11E0",)),
)
# Kinds by extension, where the bytes tell none.
DETECTOR_EXTENSIONS = {
    "text": ("txt", "md", "log", "csv", "json", "yaml", "yml"),
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif"),
    "document": ("doc", "docx", "pdf", "xls", "xlsx", "ppt", "pptx"),
    "archive": ("zip", "rar", "7z", "tar", "gz"),
}


def detector_type(content: Column, name: Column) -> Column:
    """image, archive, document, text or other: the coarse kind by 261 bytes, then by extension.

    PDF and zipped office files count as archives by their bytes; heads under 261 bytes are padded with
    NUL, so short texts go by their extension.
    """
    head = F.substring(content, 1, 261)
    plain = (F.octet_length(head) == 261) & ~_text(head).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    kinds = {e: k for k, es in DETECTOR_EXTENSIONS.items() for e in es}
    webp, tar = F.substring(head, 9, 4) == F.lit(b"WEBP"), F.substring(head, 258, 4) == F.lit(b"usta")
    first, *rest = DETECTOR_HEADS
    out = F.when(_any([_starts(head, m) for m in first[1]]) | webp, first[0])
    for kind, heads in rest:
        found = _any([_starts(head, m) for m in heads])
        out = out.when(found | tar if kind == "archive" else found, kind)
    return out.when(plain, "text").otherwise(_lookup(extension(name), kinds, "other"))


def has_bom(content: Column) -> Column:
    return _starts(content, "EFBBBF") | _starts(content, "FFFE") | _starts(content, "FEFF")


def is_likely_text(content: Column) -> Column:
    """A byte-order mark, or at most a tenth of control bytes in the first 1024."""
    head = _text(F.substring(content, 1, 1024))
    control = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return (F.octet_length(content) > 0) & (has_bom(content) | (control / F.greatest(F.lit(1), F.length(head)) <= 0.1))


def is_printable_text(content: Column) -> Column:
    """Not empty, and no control byte in the first 512."""
    return (F.octet_length(content) > 0) & ~_text(F.substring(content, 1, 512)).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def is_xml(text: Column) -> Column:
    """Starts with an XML declaration, or with a tag that has xmlns or a colon and is not html."""
    t = F.regexp_replace(text, r"^\s+", "")
    tag = F.regexp_extract(t, r"^<([^>]*)>", 1)
    low = F.lower(tag)
    named = F.contains(tag, F.lit("xmlns")) | F.contains(tag, F.lit(":"))
    return F.startswith(t, F.lit("<?xml")) | ((tag != "") & ~F.startswith(low, F.lit("!doctype html")) & ~F.startswith(low, F.lit("html")) & named)


def is_html(text: Column) -> Column:
    """The doctype, 2 of 12 signs, or an html element."""
    t = F.regexp_replace(F.lower(text), r"^\s+", "")
    return F.startswith(t, F.lit("<!doctype html")) | (_count(_has(t, *HTML_SIGNS)) >= 2) | (F.contains(t, F.lit("<html")) & F.contains(t, F.lit("</html>")))


def is_mhtml(text: Column) -> Column:
    """MIME headers with a related or html part, or a boundary or location of a part."""
    low = F.lower(text)
    mime = F.contains(low, F.lit("mime-version:")) & F.contains(low, F.lit("content-type:")) & _any(_has(low, "multipart/related", "text/html"))
    return mime | _any(_has(text, "------=_", "Content-Location:"))


def is_eml(text: Column) -> Column:
    """At least 3 of 5 mail headers."""
    return _count(_has(F.lower(text), *MAIL_HEADERS)) >= 3


def magic_extension(content: Column) -> Column:
    """The extension by magic number; '' if none fits."""
    out = F.lit("")
    for form, ext in reversed(MAGIC):
        out = F.when(_starts(content, form), ext).otherwise(out)
    return out


def extension(name: Column) -> Column:
    """Lower-case extension of a file name or path; '' without one."""
    return F.lower(F.regexp_extract(name, r"\.([^./\\]*)\z", 1))


def zip_subtype(content: Column, name: Column) -> Column:
    """ofd, docx (docm, dotx or dotm by name), wps or zip, by member names in the first 8192 bytes."""
    t, ext = _text(F.substring(content, 1, 8192)), extension(name)
    ofd = _any(_has(t, "OFD.xml", "ofd.xml")) | (F.contains(t, F.lit("Document.xml")) & F.contains(t, F.lit("Doc_")))
    word = _any(_has(t, "[Content_Types].xml", "word/"))
    wps = F.contains(t, F.lit("customXml")) & F.contains(t, F.lit("wps"))
    return F.when(ofd, "ofd").when(word, F.when(ext.isin("docm", "dotx", "dotm"), ext).otherwise("docx")).when(wps, "wps").otherwise("zip")


def ole_subtype(content: Column, name: Column) -> Column:
    """wps (wpt by name) by its makers' strings in the first 8192 bytes, else doc."""
    t = _text(F.substring(content, 1, 8192))
    return F.when(_any(_has(t, "Kingsoft", "WPS Office", "\x00W\x00P\x00S")), F.when(extension(name) == "wpt", "wpt").otherwise("wps")).otherwise("doc")


def content_extension(content: Column) -> Column:
    """xml, html, mht, eml or txt by the first 4096 bytes; '' if it doesn't look like text."""
    head = F.substring(content, 1, 4096)
    t = _text(head)
    low = F.lower(t)
    xhtml = _any(_has(low, "<!doctype html", "<html", 'xmlns="http://www.w3.org/1999/xhtml"'))
    kind = (
        F.when(is_xml(t), F.when(xhtml, "html").otherwise("xml")).when(is_html(t), "html").when(is_mhtml(t), "mht").when(is_eml(t), "eml")
        .when(F.is_valid_utf8(head.cast("string")) & is_printable_text(head), "txt").otherwise("")
    )
    return F.when(is_likely_text(head), kind).otherwise("")


def _lookup(ext: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), ext), F.lit(other))


def category(ext: Column) -> Column:
    return _lookup(ext, {e: c for c, es in CATEGORIES.items() for e in es}, "other")


def file_type(content: Column, name: Column) -> Column:
    """struct(ext, mime, category, method, reliable) by magic number, then content, then extension."""
    m = magic_extension(F.substring(content, 1, 16))
    magic = (
        F.when(m == "zip", zip_subtype(content, name)).when(m == "doc", ole_subtype(content, name))
        .when((m == "webp") & (F.substring(content, 9, 4) != F.lit(b"WEBP")), "").otherwise(m)
    )
    told = content_extension(content)
    named = F.when(category(extension(name)) == "other", "").otherwise(extension(name))
    ext = F.when(magic != "", magic).when(told != "", told).otherwise(named)
    method = F.when(magic != "", "magic").when(told != "", "content").when(named != "", "extension").otherwise("unknown")
    return F.struct(
        ext.alias("ext"), _lookup(ext, MIME, "application/octet-stream").alias("mime"), category(ext).alias("category"),
        method.alias("method"), method.isin("magic", "content").alias("reliable"),
    )


def is_supported(cat: Column) -> Column:
    return cat.isin(*SUPPORTED)


def unsupported_reason(cat: Column) -> Column:
    return _lookup(cat, UNSUPPORTED_REASONS, "不支持的文件类型")


def extension_fits(detected: Column, expected: Column) -> Column:
    """Whether a detected extension and the named one are the same or of one category; unknown ones fit."""
    return (detected == "") | (category(expected) == "other") | (detected == expected) | (category(detected) == category(expected))
