import hashlib
import ipaddress
import random

import duckdb
import pytest
from docsift.functions import text as tx
from docsift.functions.regex import to_java
from docsift.operators import alerts, dispatch, features, hashing, keywords, markers, net, policy, score, sniff, style
from docsift.operators.alerts import PRIORITY
from docsift.plans.packs import KEYWORD_ORDER, LATIN, OFFICIAL, OFFICIAL_COMPAT
from docsift.plans.queries import OFFICIALS
from pyspark.sql import functions as F

PROBES = [*OFFICIALS, "a\rb\x0b关于甲乙\n的通知", "机密 ★", "绝密★\n", "通知\n", "x\x85y", "[〔2024〕1号", "tel (010) 123-4567\n", "a@b.co 1.2.3.4", ""]


@pytest.mark.parametrize("pack", [OFFICIAL, LATIN], ids=lambda p: p.name)
def test_patterns_mean_the_same_in_both_engines(spark, pack):
    pats = {**pack.patterns, "strict": pack.strict_marker, "loose": pack.loose_marker}
    got = spark.createDataFrame(list(enumerate(PROBES)), "i int, t string").select("i", *[F.regexp_extract("t", to_java(p), 0).alias(n) for n, p in pats.items()]).orderBy("i").collect()
    c = duckdb.connect()
    for i, t in enumerate(PROBES):
        want = c.execute("SELECT " + ", ".join(f"regexp_extract($1, '{p.replace(chr(39), chr(39) * 2)}', 0)" for p in pats.values()), [t]).fetchone()
        assert tuple(got[i])[1:] == want


def test_translator():
    assert to_java(r"a\s[\s$]$") == "(?d)a[\\t\\n\\f\\r ][\\t\\n\\f\\r $]\\z"
    assert to_java(r"[\p{Han}]\p{Han}") == r"(?d)[\p{IsHan}]\p{IsHan}"
    with pytest.raises(ValueError):
        to_java(r"\bx")


@pytest.mark.parametrize("text,level,match", [
    ("文件头\n绝密★\n内容", 1, "绝密★"), ("机密★10年", 2, "机密★10年"), ("秘密★长期", 3, "秘密★长期"), ("机密 ★ 10年", 2, "机密 ★ 10年"),
    ("绝密*20年", 1, "绝密*20年"), ("这是一个秘密的故事", 0, ""), ("这也是机密文件", 0, ""), ("绝  密★", 0, ""),
])
def test_strict_markers(spark, text, level, match):
    m, n = markers.strict(F.lit(text), OFFICIAL)
    assert tuple(spark.range(1).select(tx.trim(m), n).first()) == (match, level)


def test_byte_words_fixed_and_compatible(spark):
    rows = [(w, w.encode(codec)) for w in ("绝密", "机密", "秘密") for codec in ("utf-8", "gbk", "utf-16-le")]
    df = spark.createDataFrame([(w, bytearray(b)) for w, b in rows], "w string, b binary")
    fixed = df.select("w", markers.byte_scan(F.col("b"), OFFICIAL)[0].alias("l")).collect()
    assert all(r.l.startswith(r.w) for r in fixed)
    compat = {(r.w, r.l) for r in df.select("w", markers.byte_scan(F.col("b"), OFFICIAL_COMPAT)[0].alias("l")).collect()}
    assert ("绝密", "绝密(GBK)") in compat and sum(not label for _, label in compat) >= 1


HEADS = [("504b030414000600", "office"), ("d0cf11e0a1b11ae1", "binary"), ("255044462d312e35", "pdf"), ("89504e470d0a1a0a", "image"), ("48656c6c6f20576f726c64", "text"), ("7b5c72746631", "binary"), ("00", "unknown")]


@pytest.mark.parametrize("head,kind", HEADS)
def test_marker_types(spark, head, kind):
    df = spark.range(1).select(F.unhex(F.lit(head)).alias("c"))
    assert df.select(sniff.marker_type(F.col("c"), compat=False)).first()[0] == kind
    if kind == "text":
        assert df.select(sniff.marker_type(F.col("c"))).first()[0] == "binary"


def facts(spark, text, style=None):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return score.scored(features.facts(df, "text", OFFICIAL)).first()


OFFICIAL_DOC = (
    "国办发〔2024〕1号\n\n关于印发《某某实施方案》的通知\n\n各省、自治区、直辖市人民政府，国务院各部委、各直属机构：\n\n现将《某某实施方案》印发给你们，请认真贯彻执行。\n\n"
    "附件：某某实施方案\n\n国务院办公厅\n2024年1月15日\n\n抄送：各省委办公厅、省政府办公厅。\n国务院办公厅 2024年1月15日印发\n"
)


def test_official_document(spark):
    r = facts(spark, OFFICIAL_DOC)
    assert (r.doc_number, r.title, r.title_type, r.issue_date) == ("国办发〔2024〕1号", "关于印发《某某实施方案》的通知", "通知", "2024年1月15日")
    assert r.main_send == "各省、自治区、直辖市人民政府，国务院各部委、各直属机构：" and r.attachment == "附件：某某实施方案"
    assert r.is_official and r.confidence == "很高" and r.total_score == 1.0 and r.text_length == len(OFFICIAL_DOC.encode())
    plain = facts(spark, "今天天气很好，适合散步。")
    assert plain.total_score == 0 and plain.confidence == "很低" and not plain.is_official


@pytest.mark.parametrize("line,number", [
    ("000001", "000001"), ("第000123号", "000123"), ("份号：000456", "000456"), ("编号: 000789", "000789"), ("000321 机密", "000321"),
    ("1234567", ""), ("12345", ""), ("", ""), ("第12345号", ""), ("\n" * 10 + "000001", ""),
])
def test_copy_numbers(spark, line, number):
    assert spark.range(1).select(features.copy_number(F.lit(line), OFFICIAL)).first()[0] == number


@pytest.mark.parametrize("n,total", [(50, 0.03), (150, 0.10), (500, 0.18)])
def test_short_text_penalty(spark, n, total):
    empty = {f: F.lit("") for f in features.FACTS} | {k: F.array().cast("array<string>") for k in KEYWORD_ORDER}
    df = spark.range(1).withColumns(empty | {"doc_number": F.lit("x"), "text_length": F.lit(n)})
    assert round(score.scored(df).first().total_score, 6) == total


@pytest.mark.parametrize("value,band", [(0.85, "很高"), (0.84, "高"), (0.7, "高"), (0.55, "中"), (0.4, "低"), (0.39, "很低")])
def test_bands(spark, value, band):
    assert spark.range(1).select(score.confidence_band(F.lit(value))).first()[0] == band


def test_weights_validate():
    assert not score.DEFAULT.validate() and score.Weights(text_part=0.9).validate() and score.Weights(threshold=2).validate()


def test_keyword_counts_are_of_the_pack():
    assert [len(OFFICIAL.keywords[k]) for k in KEYWORD_ORDER] == [64, 40, 35, 13, 14, 39, 35]


@pytest.mark.parametrize("source,text,want", [
    ("机密 AND 文档", "机密的文档", True), ("秘密 OR 绝密", "绝密", True), ("a (b OR c)", "a c", True), ("a (b OR c)", "a", False),
    ("NOT a", "b", True), ("NOT (a OR b) c", "c", True), ("NOT (a OR b) c", "b c", False), ("ORbit", "an orbit", True),
])
def test_expressions(spark, source, text, want):
    assert spark.range(1).select(keywords.expression(F.lit(text), source)).first()[0] is want


@pytest.mark.parametrize("bad", ["", "a AND", "(a", "a)", "OR a"])
def test_bad_expressions(spark, bad):
    with pytest.raises(ValueError):
        keywords.expression(F.lit(""), bad)


def test_hash_rules_of_both_kinds(spark):
    abc = b"abc"
    assert hashlib.new("sm3", abc).hexdigest() == "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    files = spark.createDataFrame([(1, bytearray(abc)), (2, bytearray(b"")), (3, bytearray(b"x"))], "id int, content binary")
    rules = [(10, 0, hashlib.md5(abc).hexdigest(), "m", 0), (11, 1, hashlib.new("sm3", abc).hexdigest(), "", 1), (12, 0, hashlib.md5(abc).hexdigest(), "later", 2), (13, 0, hashlib.md5(b"").hexdigest(), "empty", 3)]
    got = hashing.hash_hits(files, spark.createDataFrame(rules, "rule_id int, rule_type int, rule_content string, rule_desc string, ord int"), ["id"]).collect()
    assert sorted((r.id, r.hit.rule_id, r.hit.rule_desc) for r in got) == [(1, 11, "SM3 hash rule"), (1, 12, "later")]
    made = hashing.rules_of(files, "content", "id").collect()
    assert sorted(r.rule_id for r in made) == [1001, 1002, 1003]


def test_rule_numbers_over_many_partitions(spark):
    files = spark.createDataFrame([(f"f{i:03}", bytearray(b"%d" % i)) for i in range(300)] + [("f007", bytearray(b"7"))], "n string, content binary").repartition(9)
    got = hashing.rules_of(files, "content", "n").orderBy("rule_id").collect()
    assert [r.rule_id for r in got] == list(range(1001, 1302)) and [r.rule_desc for r in got] == sorted([*(f"f{i:03}" for i in range(300)), "f007"])
    assert [r.ord for r in got] == list(range(1, 302)) and hashing.rules_of(files.limit(0), "content", "n").count() == 0


def test_whitelist_ranges_and_names(spark):
    conn = spark.createDataFrame([(ip,) for ip in ("10.1.2.3", "11.0.0.1", "1.2.3.4", "1.2.3.5", "0.0.0.0", None, "999.1.1.1", "::1", "fe80::1")], "remote_ip string")
    wl = spark.createDataFrame([("10.0.0.0/8",), ("1.2.3.4",), ("fe80::1",), ("bad/99",)], "entry string")
    assert sorted(r.remote_ip for r in net.violations(conn, wl).collect()) == ["1.2.3.5", "11.0.0.1", "999.1.1.1"]


def test_addresses_of_both_families_are_pythons(spark):
    rng = random.Random(11)
    texts = ["::", "::1", "1::", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "64:ff9b::1.2.3.4", "12345::", "g::", ":::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "FE80::A", "", ":", "1.2.3.4", "1.2.3", "256.1.1.1", None]
    for _ in range(300):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))
        texts.append(rng.choice([a.compressed, a.exploded, a.compressed.upper()]))
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", net.address(F.col("t")).alias("a")).orderBy("i").collect()
    for t, r in zip(texts, got):
        try:
            want = ipaddress.ip_address(t) if t and "%" not in t else None
        except ValueError:
            want = None
        want = getattr(want, "ipv4_mapped", None) or want
        of = lambda x: (x.family, (x.hi % (1 << 64)) << 64 | x.lo % (1 << 64))
        assert (want is None and r.a is None) or of(r.a) == (want.version, int(want)), t


def test_blocks_of_any_length_and_number(spark):
    rng = random.Random(12)
    base = [ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(40) << 56 | rng.getrandbits(8)) for _ in range(150)] + [ipaddress.IPv4Address((10 << 24) | rng.getrandbits(24)) for _ in range(150)]
    entries = [f"{a}/{rng.randrange(20, a.max_prefixlen + 1)}" for a in rng.sample(base, 80)] + ["::ffff:10.9.0.0/112", "2001:db8::/129", "10.0.0.0/33", "nonsense", "11.0.0.0/8", "fe80::/10", "fe80::/10"]
    conn = [str(a + rng.randrange(4)) for a in base] + ["11.1.1.1", "fe81::5", "fec0::5", "10.9.3.4", "::ffff:11.2.3.4", "0.0.0.0", "::", "odd", None]
    nets = []
    for e in entries:
        try:
            n = ipaddress.ip_network(e, strict=False)
            nets.append(ipaddress.ip_network("10.9.0.0/16") if "ffff" in e else n)
        except ValueError:
            pass

    def fits(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return False
        a = getattr(a, "ipv4_mapped", None) or a
        return any(a in n for n in nets)

    got = [r.remote_ip for r in net.violations(spark.createDataFrame([(c,) for c in conn], "remote_ip string"), spark.createDataFrame([(e,) for e in entries], "entry string")).collect()]
    assert sorted(got) == sorted(c for c in conn if c and c not in ("0.0.0.0", "::") and not fits(c))


def test_policy_outcomes(spark):
    ops = spark.createDataFrame([("m", 1, "add", 1), ("m", 2, "del", 1), ("m", 2, "del", 9)], "module string, version int, cmd string, rule_id int")
    known = spark.createDataFrame([("m", 1)], "module string, rule_id int")
    assert sorted(tuple(r) for r in policy.outcomes(ops, known).collect()) == [("m", 1, "add", 1, 0), ("m", 2, "del", 1, 1)]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.trim(F.lit("　\x85 a b\xa0\n"))) == "a b"
    assert one(tx.preprocess(F.lit(" a\r\n\r\n\r\n\rb "))) == "a\n\nb"
    assert one(tx.strip_html(F.lit("<p>a&amp;lt;b&nbsp;&copy;</p>"))) == " a&lt;b © "
    assert one(tx.numeric_entities(F.lit("&#65;&#x42;&#X4e2d;&#0;&#99999999;"))) == "AB中&#0;&#99999999;"
    assert one(tx.size_text(F.lit(1536))) == "1.50 KB" and one(tx.size_text(F.lit(7))) == "7 B"
    assert one(tx.without_short_noise(F.lit("ab\n--\n中\n.."))) == "ab\n中"
    assert one(tx.truncate(F.lit("秘密文件"), 2)) == "秘密" and bytes(one(tx.truncate_bytes(F.lit("秘密"), 4))) == "秘密".encode()[:4]
    assert one(tx.without_han_spaces(F.lit("机 密 file 文 件 3 。 文 ， x"))) == "机密 file 文件3 。文， x"
    assert one(tx.without_han_spaces(F.lit("机 密 3 ， 文"), marks=False)) == "机密3 ， 文"
    assert [one(tx.cut_bytes(F.lit(t), 5)) for t in ("abcdef", "机密", "a机密", "\ufffd\ufffd", "aé\U0001f600", "", "机a1")] == ["abcde", "机", "a机", "\ufffd", "aé", "", "机a1"]
    assert one(style.seal_hint(F.lit("市人民政府"))) is True and one(style.red_header_hint(F.lit("nothing"))) is False
    assert one(alerts.merged_level(F.array(F.lit("internal"), F.lit("top_secret"), F.lit("?")))) == "top_secret"
    assert one(sniff.unsupported_reason(F.lit("archive"))) == "压缩文件，请先解压后检测"


def test_random_bytes_never_break_sniffing(spark):
    rng = random.Random(6)
    rows = [(bytearray(rng.randbytes(rng.randrange(0, 700))), f"f{i}.{rng.choice(['txt', 'zip', '', 'docx'])}") for i in range(200)] + [(bytearray(b""), "")]
    got = spark.createDataFrame(rows, "c binary, n string").select(sniff.file_type(F.col("c"), F.col("n")).alias("t"), sniff.marker_type(F.col("c")).alias("m")).collect()
    assert len(got) == len(rows) and all(r.t.category for r in got)


def test_detectors_switched_on():
    on = dispatch.switched_on
    assert on() == list(PRIORITY) == on(["hash"], everything=True)
    assert on(["keyword", "hash"]) == ["hash", "keyword"] and on(none=True) == []
    assert on(none=True, loaded=["keyword"]) == ["keyword"] and on(["layout"], none=True) == ["layout"]


def test_dispatch_of_odd_files(spark):
    rows = [(b"", None), (None, None), (b"%PDF-1.7", "机密★5年"), (b"%PDF-1.7" + "机密★".encode(), ""), (b"\xff\xd8\xff", None), (b"\xff\xd8\xff", "秘密★"), (b"\xff\xd8\xff", "一份机密文件"), (b"\xff\xd8\xff", "没有")]
    d = spark.createDataFrame(rows, "content binary, t string").coalesce(1)
    hit = lambda **kw: [r.matched for r in d.select(dispatch.marker_hit(F.col("content"), F.col("t"), OFFICIAL, **kw).alias("h")).select("h.matched").collect()]
    assert hit() == [None, None, "机密★5年", *[None] * 5]
    assert hit(image_text=F.col("t"))[4:] == [None, "秘密 (OCR)", "机密 (OCR)", None]
    kinds = d.select(dispatch.electronic_input(F.col("content"), F.lit("x.pdf"))).collect()
    assert [k[0] for k in kinds] == [None, None, None, None, *["image"] * 4]


def test_garbage_share_takes_one_pass_over_any_text(spark):
    from docsift.operators import style

    texts = ["", None, "a", "aab", "😀" * 3 + "b", "\U0010fffd", "\x00\x00x", "".join(map(chr, range(0x4E00, 0x9000))) + "a" * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = style.is_garbage(df, "doc_id", "text", 0.5)
    got = {r.doc_id: (r.top_share, r.is_garbage) for r in out.collect()}
    share = {i: t and max(t.count(c) for c in set(t)) / len(t) for i, t in enumerate(texts) if t is not None}
    assert got == {i: (None, None) if t is None else (share[i] or 0.0, (share[i] or 0.0) > 0.5) for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().toString()  # a replacement for each different character took time by their number
    assert "ArrowEvalPython" in plan and "array_distinct" not in plan
