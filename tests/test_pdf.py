import random
import zlib

import pytest
from docsift.operators import dispatch
from docsift.plans.packs import OFFICIAL
from docsift.sources import pdf
from pyspark.sql import functions as F

TEXTS = ["first page\nof (two) \\lines\\", "机密★10年\r\n第二页 😀 \x01\t", "", "\n\nblank lines\n\n", "x" * 5000, "".join(map(chr, range(0x100, 0x700)))]


@pytest.mark.parametrize("packed", [False, True])
def test_pages_come_back(packed):
    for texts in (TEXTS, ["one"], ["a\nb"] * 40):
        data = pdf.to_pdf(texts, packed)
        assert pdf.page_texts(data) == texts
        assert pdf.page_texts(data.replace(b"startxref\n", b"startxref\n9")) == texts  # objects found by a scan
        assert pdf.page_texts(b"junk\n" + data) == texts


def small(content, *more, resources=b"<</Font<</F 5 0 R>>>>"):
    out = b"%PDF-1.4\n1 0 obj <</Pages 2 0 R>> endobj 2 0 obj <</Kids[3 0 R] >> endobj\n"
    out += b"3 0 obj <</Type/Page/Resources " + resources + b"/Contents[4 0 R 99 0 R]>> endobj\n4 0 obj <</Length 9 0 R>>stream\n" + content + b"\nendstream endobj\n"
    return out + b"\n".join(more) + b"\ntrailer <</Root 1 0 R>>"


def test_operators_and_strings():
    font = b"5 0 obj <</Type/Font/Subtype/Type1>> endobj"
    at = lambda content: pdf.page_texts(small(content, font))
    assert at(rb"BT /F 1 Tf (a(b(c))\)\\\101\7) Tj ET") == ["a(b(c)))\\A\x07"]
    assert at(b"BT (one) Tj 0 -12 Td (two) Tj 5 0 Td (three) Tj T* (four) Tj ET BT (five) Tj ET") == ["one\ntwothree\nfour\nfive"]
    assert at(b"BT (a) ' 1 2 (b) \" [(c) -300 <64>] TJ ET") == ["\na\nbcd"]
    assert at(b"BT <48 65 6C6> Tj ET") == ["Hel`"] and at(b"BT <feff673a> Tj ET") == ["机"]
    assert at(b"BT (x) Tj ET BI /W 1 ID \x00(Tj)\xff EI BT (y) Tj ET") == ["x\ny"]
    assert at(b"BT (never closed Tj ET") == [""] and at(b"") == [""] and at(b"BT (\\\n\\r\\n) Tj ET") == ["\r\n"]


def test_maps_of_codes():
    cmap = b"begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 beginbfrange <8001> <8003> <4e00> <8004><8005>[<0041><00420043>] endbfrange 1 beginbfchar <01> <d83dde00> endbfchar"
    font = b"5 0 obj <</ToUnicode 6 0 R>> endobj 6 0 obj <</Filter[/AHx/FlateDecode]>>stream\n" + zlib.compress(cmap).hex().encode() + b">\nendstream endobj"
    assert pdf.page_texts(small(b"BT /F 1 Tf <80018003 01 80048005 41 9999> Tj ET", font)) == ["一丂😀ABCA"]


def test_forms_and_loops():
    form = b"7 0 obj <</Subtype/Form/Resources<</XObject<</X 7 0 R>>>>>>stream\nBT (in form) Tj ET /X Do\nendstream endobj"
    assert pdf.page_texts(small(b"/X Do", form, resources=b"<</XObject<</X 7 0 R>>>>")) == ["in form"]
    loop = b"%PDF-1.4\n1 0 obj <</Pages 2 0 R>> endobj 2 0 obj <</Kids[2 0 R 3 0 R 3 0 R]>> endobj 3 0 obj <</Contents 3 0 R>> endobj trailer <</Root 1 0 R>>"
    assert pdf.page_texts(loop) == [""]


def test_an_older_table_is_followed():
    data = pdf.to_pdf(["old", "kept"])
    first = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    body = zlib.compress(b"BT (new) Tj ET")
    at = len(data)
    data += b"6 0 obj\n<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj\n" % (len(body), body)
    data += b"xref\n6 1\n%010d 00000 n \ntrailer <</Size 9/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, first, len(data))
    assert pdf.page_texts(data) == ["new", "kept"]


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4", pdf.to_pdf(["x"]).replace(b"/Root", b"/Encrypt 1 0 R/Root"), b"%PDF-1.4 1 0 obj " + b"[" * 100_000])
def test_broken_files_are_errors_and_never_hang(spark, data):
    got = pdf.pages(spark.createDataFrame([("p", bytearray(data))], "path string, content binary")).first()
    assert got.pages is None and got.error


def test_random_damage_never_breaks_the_job(spark):
    rng = random.Random(4)
    rows = [(None, None)]
    for i in range(150):
        data = bytearray(pdf.to_pdf(TEXTS[:3], i % 2 == 0))
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        rows.append((str(i), data[: rng.randrange(len(data))] if i % 3 == 0 else data))
    got = pdf.pages(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert len(got) == 151 and all((r.pages is None) != (r.error is None) for r in got)


def test_lines(spark):
    cases = [
        ("中 文 file  name 3 a\n– 12 –\n17\n第一句。第二句！”他说。\r\n\x07末", "中文file  name3a\n第一句。\n第二句！”他说。\n末"), ("", ""), (None, None), ("a \n b\t c", "a\nb  c"),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[1] for r in d.select("i", pdf.line_text(F.col("t"))).orderBy("i").collect()] == [w for _, w in cases]


def test_marker_of_the_first_pages(spark):
    rows = [("a", ["x", "机密★10年", "绝密★"]), ("b", ["x"] * 5 + ["绝密★"]), ("c", []), ("d", None)]
    d = spark.createDataFrame(rows, "k string, p array<string>").withColumn("content", F.lit(b"%PDF-1.7 \xe7\xbb\x9d\xe5\xaf\x86"))
    hit = dispatch.marker_hit(F.col("content"), F.lit(None).cast("string"), OFFICIAL, pages=F.col("p"))
    got = {r.k: r.h and (r.h.matched, r.h.level) for r in d.select("k", hit.alias("h")).collect()}
    assert got["a"] == ("机密★10年 (Page 2)", 2) and got["b"] is None and got["c"] is None
    assert got["d"][0].startswith("绝密")  # not readable, so its bytes are scanned


def test_codes_of_one_length_are_looked_up_at_once():
    font = pdf._Font(pdf.Pdf(pdf.to_pdf(["x"])), None)
    font.map, font.wide = {(i + 1).to_bytes(2, "big"): c for i, c in enumerate("aé中😀\x00")}, [2]
    slow = font.text(b"".join(font.map) + b"\x00\x09\x00\x01")
    made = pdf.Pdf(pdf.to_pdf(["aé中😀"]))
    fast = pdf._Font(made, made.get(made.get(made.pages[0]["Resources"])["Font"]["F1"]))
    assert fast.table is not None and slow == "aé中😀\x00a"
    raw = b"".join(fast.map) + b"\x00\x09\x00\x01"
    got, fast.table = fast.text(raw), None
    assert got == fast.text(raw) == "aé中😀a" and fast.text(raw + b"\x00") == "aé中😀a"
