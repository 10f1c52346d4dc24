import io
import json
import zipfile
import zlib

from docsift.operators import markers
from docsift.plans.packs import OFFICIAL
from docsift.sources import files, formats
from docsift.streaming import streams
from pyspark.sql import functions as F


def package(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in members.items():
            z.writestr(n.replace("__", "/").replace("_xml", ".xml"), t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = package(word__document_xml=f"<w:document {W}><w:body><w:p><w:r><w:t>机密★</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>", word__header1_xml=f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>")
OFD = package(Doc_0__Pages__Page_10__Content_xml="<o:a xmlns:o='u'><o:TextCode>second</o:TextCode></o:a>", Doc_0__Pages__Page_2__Content_xml="<o:a xmlns:o='u'><o:TextCode>first</o:TextCode></o:a>", OFD_xml="<SecretLevel>秘密</SecretLevel>")
PDF = b"%PDF-1.4\n1 0 obj<</Filter/FlateDecode>>\nstream\n" + zlib.compress(b"BT (Hello \\(x\\)) Tj T* <776F726C64> Tj ET") + b"\nendstream\n%%EOF"
CASES = {
    "docx": (DOCX, "head\n机密★ x\ntwo"), "ofd": (OFD, "first\n\nsecond"), "pdf": (PDF, "Hello (x)\nworld"),
    "rtf": (rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 a\'bb\'fa\'c3\'dc\par b}", "a机密\nb"), "html": (b"<p>a</p><script>no</script><p>b&amp;c</p>", "a\n\nb&c"),
    "eml": (b"From: a\nSubject: b\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\na=3Db", "a=b"),
    "txt": ("机密".encode("gbk"), "机密"), "xml": (b"<?xml version='1.0'?><a>x<![CDATA[y]]></a>", "xy"), "doc": (b"\xd0\xcf\x11\xe0" + "机密文件内容".encode("utf-16-le"), "机密文件内容"),
}


def test_formats(spark):
    rows = [(k, k, bytearray(b)) for k, (b, _) in CASES.items()] + [("broken", "docx", bytearray(b"PK nothing")), ("odd", "xyz", bytearray(b"?")), ("empty", "txt", bytearray(b""))]
    got = {r.path: r for r in formats.extracted(spark.createDataFrame(rows, "path string, ext string, content binary")).collect()}
    for k, (_, text) in CASES.items():
        assert got[k].error is None and got[k].text == text, (k, got[k])
    assert got["broken"].text is None and "BadZipFile" in got["broken"].error and got["odd"].error == "no reader for xyz" and got["empty"].text == ""
    tags = formats.tag_hits(spark.createDataFrame(rows, "path string, ext string, content binary")).collect()
    assert {(r.path, r.member, r.tag) for r in tags} == {("ofd", "OFD.xml", "SecretLevel"), ("ofd", "OFD.xml", "秘密")}
    assert "机密★" in formats.limited_text(DOCX) and formats.decode("﻿秘".encode("utf-16-le")) == "秘"


def test_docx_style():
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:jc w:val="center"/><w:spacing w:line="560"/></w:pPr><w:r><w:rPr><w:b/><w:color w:val="FF0000"/><w:sz w:val="44"/><w:rFonts w:ascii="仿宋_GB2312"/></w:rPr><w:t>x</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="2098" w:bottom="1984" w:left="1587" w:right="1474"/></w:sectPr></w:body></w:document>'
    got = formats.docx_style(package(word__document_xml=body))
    assert all(got[k] for k in ("has_red_text", "has_red_header", "has_official_fonts", "title_font_match", "is_a4_paper", "margin_match", "has_centered_title", "line_spacing_match"))
    assert not got["body_font_match"] and not got["has_seal_image"]


def test_collect_rules_write_and_store(spark, tmp_path):
    (tmp_path / "d" / ".h").mkdir(parents=True)
    for n, b in (("a.TXT", b"abc"), (".hid", b"x"), ("big.bin", b"y" * 5000), (".h/in.txt", b"z")):
        (tmp_path / "d" / n).write_bytes(b)
    names = lambda **k: sorted(r.name for r in files.collect_files(spark, str(tmp_path / "d"), **k).collect())
    assert names() == ["a.TXT", "big.bin"] and names(most_bytes=100) == ["a.TXT"] == names(glob="*.TXT")
    rule = {"rule_id": 5, "rule_type": 0, "rule_content": "ff", "rule_desc": "d"}
    (tmp_path / "p" / "hash").mkdir(parents=True)
    (tmp_path / "p" / "hash" / "policy.json").write_text(json.dumps({"rules": [rule, rule]}))
    (tmp_path / "bare.json").write_text(json.dumps([rule]))
    assert [r.ord for r in files.policy(spark, str(tmp_path / "p"), "hash").collect()] == [0, 1]
    assert files.read_rules(spark, str(tmp_path / "bare.json")).first().rule_id == 5 and files.policy(spark, str(tmp_path / "p"), "none").count() == 0
    assert files.single_hash_rule(spark, "AB" * 16).first().rule_content == "ab" * 16
    df = spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>")
    for form in ("json", "csv", "text"):
        files.write_results(df, str(tmp_path / form), form)
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).first().l == "a|b"
    store = files.Store(spark, str(tmp_path / "store"), b"k" * 16)
    store.push(df)
    store.push(df)
    assert store.pop_all("i int, l array<string>").count() == 2
    assert files.Store(spark, str(tmp_path / "store"), b"j" * 16).pop_all("i int, l array<string>").count() == 0
    store.clear()
    assert store.pop_all("i int").count() == 0


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, t in enumerate(("机密★10年" + "x" * 400, "nothing here" * 50)):
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    feed = streams.file_feed(spark, str(tmp_path / "in"), 1)
    m, level = markers.head_tail(F.col("content"), OFFICIAL)
    q = streams.run_to(feed.select("path", m.alias("m"), level.alias("level")).where("m <> ''"), streams.to_table(str(tmp_path / "out")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.level for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    conn = spark.createDataFrame([("2024-01-01 00:00:00", "9.9.9.9", 80), ("2024-01-01 00:10:00", "9.9.9.9", 5000), ("2024-01-01 00:11:00", "10.0.0.1", 1)], "t string, remote_ip string, local_port int").select(F.to_timestamp("t").alias("ts"), "remote_ip", "local_port")
    conn.coalesce(1).write.parquet(str(tmp_path / "conn"))
    feed = streams.table_feed(spark, str(tmp_path / "conn"), "ts timestamp, remote_ip string, local_port int")
    wl = spark.createDataFrame([("10.0.0.0/8",)], "entry string")
    streams.run_to(streams.network_alerts(feed, wl), streams.to_table(str(tmp_path / "net")), str(tmp_path / "ck2")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "net")).collect()
    assert len(got) == 1 and got[0].remote_ip == "9.9.9.9"
    base = spark.createDataFrame([("p", "old")], "path string, digest string")
    spark.createDataFrame([("p", bytearray(b"new")), ("q", bytearray(b""))], "path string, content binary").coalesce(1).write.parquet(str(tmp_path / "f"))
    feed = streams.table_feed(spark, str(tmp_path / "f"), "path string, content binary")
    streams.run_to(streams.integrity_alerts(feed, base), streams.to_table(str(tmp_path / "int")), str(tmp_path / "ck3")).awaitTermination(120)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "int")).collect()] == ["p"]
