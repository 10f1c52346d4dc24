"""Registered queries over the driver's tables, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import once
from ..functions.tables import numbered, shared_dir, written
from ..operators import alerts, dispatch, failures, features, hashing, integrity, keywords, markers, net, policy, reports, score, sniff, style
from ..sources import files, pdf, stores
from ..streaming import monitor, stateful, streams
from . import sql
from .packs import KEYWORD_ORDER, LATIN, OFFICIAL, OFFICIAL_COMPAT, Pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# Golden rows: markers, official documents and layouts, the same on both sides.
MARKERS = (
    "文件头\n绝密★\n内容", "机密★10年", "秘密★长期", "机密 ★ 10年", "绝密*20年", "这是一个秘密的故事", "这也是机密文件", "绝  密★", "秘密 *\n5年 后", "",
)
OFFICIALS = (
    "000123\n机密★10年\n特急\n京政办发〔2023〕15号\n签发人：王小明\n关于做好防汛工作的通知\n各有关部门：\n根据国务院办公厅要求，现将有关事项通知如下，请遵照执行。\n"
    "附件：1. 任务分工表\n市人民政府\n2023年5月6日\n抄送：市委办公室、市人大。\n市政府办公室 2023年5月7日印发",
    "〔2022〕7号 关于召开年会的请示 妥否，请批示。2022-03-04", "第000456号\n关于修订财务管理办法的决定\n各单位：为进一步规范，特此通知。",
    "客户订单报价：限时优惠，点击咨询热线。关于新品的报告，价格与合同见附件", "纯属闲谈，没有任何特征。", "份号：000789 编号: 111222 2024年1月15日", "",
)
LAYOUTS = (
    ("全", "〔2024〕1号", "关于甲的通知", "2024年1月1日", "", 500, True, True, True, True, True, True, True, True, True, True, False),
    ("图", "〔2024〕1号", "", "", "", 150, True, True, False, False, False, True, False, False, False, True, True),
    ("头", "", "关于乙的函", "", "000001", 90, False, True, False, False, False, True, True, False, False, False, True),
    ("章", "", "", "", "", 220, False, True, False, False, False, False, False, False, False, True, True),
    ("无", "", "", "", "", 40, False, False, False, True, True, False, True, True, True, False, False),
)
_STYLE = list(score.STYLE_WEIGHTS)


def golden(spark: SparkSession, rows: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)


def golden_sql(rows: tuple[str, ...]) -> str:
    lit = lambda s: sql.q(s).replace("\n", "' || chr(10) || '")
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {lit(t)})" for i, t in enumerate(rows)) + ") v(doc_id, text))"


def _marker_sql(source: str, pack: Pack, pattern: str) -> str:
    m = sql.first("text", pattern)
    return f"SELECT {sql.q(pack.name)} AS pack, doc_id, {sql.trim(m)} AS matched, ({sql.level(sql.first('text', pattern, 1), pack)})::BIGINT AS level FROM {source} WHERE {m} <> ''"


def _marker(df: DataFrame, pack: Pack, find) -> DataFrame:
    m, level = find(F.col("text"), pack)
    return df.select(F.lit(pack.name).alias("pack"), "doc_id", tx.trim(m).alias("matched"), level.cast("bigint").alias("level")).where("matched <> ''")


@query(_marker_sql(golden_sql(MARKERS), OFFICIAL, OFFICIAL.strict_marker) + " UNION ALL " + _marker_sql("documents", LATIN, LATIN.strict_marker))
def marker_strict_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marker(golden(spark, MARKERS), OFFICIAL, markers.strict).unionByName(_marker(table(spark, sf_dir, "documents"), LATIN, markers.strict))


@query(_marker_sql(golden_sql(MARKERS), OFFICIAL, OFFICIAL.loose_marker) + " UNION ALL " + _marker_sql("documents", LATIN, LATIN.loose_marker))
def marker_loose_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marker(golden(spark, MARKERS), OFFICIAL, markers.loose).unionByName(_marker(table(spark, sf_dir, "documents"), LATIN, markers.loose))




@query(f"""WITH b AS (SELECT doc_id, text, encode(text) AS c, octet_length(encode(text)) AS n FROM documents),
 w AS (SELECT doc_id, n, hex(c[1:4096]) AS h, hex(CASE WHEN n > 4096 THEN c[greatest(4096, n - 2048) + 1:n] ELSE ''::BLOB END) AS t FROM b)
 SELECT doc_id, n::BIGINT AS n_bytes, regexp_matches(h, '^(..)*?746F6B656E|^(..)*?736563726574|^(..)*?70617373776F7264') AS head, regexp_matches(t, '^(..)*?746F6B656E|^(..)*?736563726574|^(..)*?70617373776F7264') AS tail FROM w""")
def marker_head_tail_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    head, tail = markers.windows(F.col("text").cast("binary"))
    word = "token|secret|password"
    return d.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), head.rlike(word).alias("head"), tail.rlike(word).alias("tail"))


def _byte_sql(source: str, pack: Pack) -> str:
    label, level = sql.byte_scan("hexa", pack)
    return f"SELECT pack, doc_id, label, level::BIGINT AS level FROM (SELECT {sql.q(pack.name)} AS pack, doc_id, {label} AS label, {level} AS level FROM (SELECT doc_id, hex(encode(text)) AS hexa FROM {source})) WHERE label <> ''"


def _bytes(df: DataFrame, pack: Pack) -> DataFrame:
    label, level = markers.byte_scan(F.col("text").cast("binary"), pack)
    return df.select(F.lit(pack.name).alias("pack"), "doc_id", label.alias("label"), level.cast("bigint").alias("level")).where("label <> ''")


@query(" UNION ALL ".join([_byte_sql(golden_sql(MARKERS), OFFICIAL), _byte_sql(golden_sql(MARKERS), OFFICIAL_COMPAT), _byte_sql("documents", LATIN)]))
def byte_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = golden(spark, MARKERS)
    return _bytes(g, OFFICIAL).unionByName(_bytes(g, OFFICIAL_COMPAT)).unionByName(_bytes(table(spark, sf_dir, "documents"), LATIN))


_CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"


@query(f"SELECT doc_id, CASE WHEN octet_length(encode(text)) < 257 THEN 'binary' WHEN regexp_matches(text, '{_CONTROL}') THEN 'binary' ELSE 'text' END AS kind, "
       f"CASE WHEN octet_length(encode(text)) < 5 THEN 'unknown' ELSE 'text' END AS plain_kind FROM documents")
def type_sniff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text").cast("binary")
    plain = F.when(F.octet_length(c) < 5, "unknown").otherwise(sniff.marker_type(c, compat=False))
    return table(spark, sf_dir, "documents").select("doc_id", sniff.marker_type(c).alias("kind"), plain.alias("plain_kind"))


@query("SELECT lang, count(*) FILTER (octet_length(encode(text)) < 257) AS short, count(*) AS n FROM documents GROUP BY lang")
def short_file_is_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = sniff.marker_type(F.col("text").cast("binary"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(reports.count_if(kind == "binary").alias("short"), F.count("*").alias("n"))


_ALL_TEXTS = "(SELECT 'page' AS kind, page_id AS id, html AS text FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)"


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return pages.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))


_SIGNS = " + ".join(f"contains(low, {sql.q(w)})::INT" for w in sniff.HTML_SIGNS)


@query(f"SELECT kind, id, starts_with(low, '<!doctype html') OR ({_SIGNS}) >= 2 OR (contains(low, '<html') AND contains(low, '</html>')) AS is_html FROM (SELECT *, regexp_replace(lower(text), '^[ \\t\\n\\f\\r\\x0B]+', '') AS low FROM {_ALL_TEXTS})")
def html_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_texts(spark, sf_dir).select("kind", "id", sniff.is_html(F.col("text")).alias("is_html"))


_HEADERS = " + ".join(f"contains(lower(text), {sql.q(w)})::INT" for w in sniff.MAIL_HEADERS)
_MAILS = ("From: a\nTo: b\nSubject: c\n\nbody", "MIME-Version: 1.0\nContent-Type: multipart/related", "Content-Location: x", "to: only", "------=_part")


@query(f"SELECT doc_id, (contains(lower(text), 'mime-version:') AND contains(lower(text), 'content-type:') AND (contains(lower(text), 'multipart/related') OR contains(lower(text), 'text/html'))) OR contains(text, '------=_') OR contains(text, 'Content-Location:') AS is_mhtml, ({_HEADERS}) >= 3 AS is_eml FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id - 100, text FROM {golden_sql(_MAILS)})")
def mime_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden(spark, _MAILS).withColumn("doc_id", F.col("doc_id") - 100))
    return d.select("doc_id", sniff.is_mhtml(F.col("text")).alias("is_mhtml"), sniff.is_eml(F.col("text")).alias("is_eml"))


@query(f"SELECT page_id, md5({sql.strip_html('html')}) AS text_md5, length({sql.strip_html('html')})::BIGINT AS n FROM pages")
def html_strip_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n"))


@query(f"SELECT page_id, length({sql.entities('html')})::BIGINT AS n, md5({sql.entities('html')}) AS text_md5 FROM pages WHERE {sql.entities('html')} <> html")
def html_entities_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.named_entities(F.col("html"))
    return table(spark, sf_dir, "pages").where(t != F.col("html")).select("page_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("text_md5"))


_XMLS = ("<?xml version='1.0'?><a>x<![CDATA[<b>]]></a>", "<p>one</p><!-- c -->", "plain < 3", "<![CDATA[two\nlines]]>", "")


@query(f"SELECT doc_id, {sql.strip_xml('text')} AS text FROM {golden_sql(_XMLS)} UNION ALL SELECT page_id + 100, md5({sql.strip_xml('html')}) FROM pages")
def xml_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 100).alias("doc_id"), F.md5(tx.strip_xml(F.col("html"))).alias("text"))
    return golden(spark, _XMLS).select("doc_id", tx.strip_xml(F.col("text")).alias("text")).unionByName(pages)


@query(f"SELECT doc_id, length({sql.normalize_whitespace('text')})::BIGINT AS n, md5({sql.normalize_whitespace('text')}) AS text_md5 FROM documents")
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.normalize_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("bigint").alias("n"), F.md5(t).alias("text_md5"))


@query(f"SELECT doc_id, translate({sql.lf('text')}, {sql.q(tx.FULL_WIDTH)}, {sql.q(tx.HALF_WIDTH)}) AS text FROM {golden_sql(OFFICIALS)}")
def punctuation_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark, OFFICIALS).select("doc_id", tx.normalize_punctuation(F.col("text")).alias("text"))


@query(f"{sql.pattern_rows('documents', 'text', LATIN, 'doc_id')} UNION ALL SELECT doc_id - 100, pattern, matched FROM ({sql.pattern_rows(golden_sql(OFFICIALS), 'text', OFFICIAL, 'doc_id')})")
def pattern_match_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = features.pattern_rows(golden(spark, OFFICIALS), F.col("text"), OFFICIAL, ["doc_id"]).withColumn("doc_id", F.col("doc_id") - 100)
    return features.pattern_rows(table(spark, sf_dir, "documents"), F.col("text"), LATIN, ["doc_id"]).unionByName(g)


def _set_sql(source: str, pack: Pack) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {sql.q(k)} AS set_name, {sql.matched('low', pack.keywords[k])} AS m, {pack.keyword_weights[k]!r}::DOUBLE AS w FROM d" for k in KEYWORD_ORDER)
    return f"WITH d AS (SELECT doc_id, lower(text) AS low FROM {source}) SELECT doc_id, set_name, array_to_string(m, ',') AS matched, len(m) AS count, round(len(m) * w, 6) AS score FROM ({each}) WHERE len(m) > 0"


@query(f"SELECT * FROM ({_set_sql('documents', LATIN)}) UNION ALL SELECT doc_id - 100, set_name, matched, count, score FROM ({_set_sql(golden_sql(OFFICIALS), OFFICIAL)})")
def keyword_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(df, pack):
        return keywords.set_rows(df, F.col("text"), pack, ["doc_id"]).select("doc_id", "set_name", F.array_join("matched", ",").alias("matched"), *longs("count"), F.round("score", 6).alias("score"))

    return rows(table(spark, sf_dir, "documents"), LATIN).unionByName(rows(golden(spark, OFFICIALS), OFFICIAL).withColumn("doc_id", F.col("doc_id") - 100))


def _keyword_score_sql(pack: Pack) -> str:
    total = "0.0::DOUBLE"
    for k in KEYWORD_ORDER:
        total = f"({total} + len({sql.matched('lower(text)', pack.keywords[k])}) * {pack.keyword_weights[k]!r}::DOUBLE)"
    return sql.clamp(total)


@query(f"SELECT doc_id, round({_keyword_score_sql(LATIN)}, 6) AS score FROM documents")
def keyword_set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(keywords.keyword_score(F.col("text"), LATIN), 6).alias("score"))


@query("SELECT doc_id, contains(lower(text), 'license') OR (contains(lower(text), 'token') AND NOT contains(lower(text), 'the')) AS a, ((contains(lower(text), 'password') OR contains(lower(text), 'secret')) AND contains(lower(text), 'the') AND (contains(lower(text), 'password')::INT + contains(lower(text), 'secret')::INT + contains(lower(text), 'the')::INT) >= 2) AS b FROM documents")
def keyword_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", keywords.expression(t, "license OR (token AND NOT the)").alias("a"), keywords.expression(t, "(password OR secret) the", 2).alias("b")
    )


FEATURE_RULES = ((1, "license, Password ,@", "first", 1), (2, "secret,password,", "second", 2), (3, " tion ", "third", 3))
_RULES_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, {sql.q(c)}, {sql.q(d)}, {o})" for i, c, d, o in FEATURE_RULES) + ") r(rule_id, rule_content, rule_desc, ord)"


@query(f"""WITH f AS (SELECT lower(trim(unnest(string_split(rule_content, ',')))) AS feature, rule_id, rule_desc, ord FROM {_RULES_SQL}),
 one AS (SELECT feature, rule_id, rule_desc FROM f WHERE feature <> '' QUALIFY row_number() OVER (PARTITION BY feature ORDER BY ord DESC) = 1)
 SELECT doc_id, feature, rule_id, rule_desc FROM documents JOIN one ON contains(lower(text), feature)""")
def feature_keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(FEATURE_RULES), "rule_id long, rule_content string, rule_desc string, ord int")
    return keywords.feature_hits(table(spark, sf_dir, "documents"), F.col("text"), rules, ["doc_id"])


@query("SELECT doc_id, min(item_id) AS rule_id FROM documents JOIN benchmark b ON contains(documents.text, b.text) WHERE length(b.text) > 0 GROUP BY doc_id")
def stream_marker_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").where(F.length("text") > 0)
    rules = b.select(F.col("item_id").alias("rule_id"), F.lit("benchmark").alias("rule_desc"), F.base64(F.col("text").cast("binary")).alias("rule_content"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return hashing.byte_pattern_hits(d, rules, ["doc_id"]).select("doc_id", "rule_id")


_HASH_RULES_SQL = """(SELECT doc_id AS rule_id, md5(text) AS digest, doc_id AS ord FROM documents WHERE doc_id % 97 = 0
 UNION ALL SELECT item_id + 1000000, md5(text), item_id + 1000000 FROM benchmark UNION ALL SELECT doc_id + 5000000, md5(text), doc_id + 5000000 FROM documents WHERE doc_id % 194 = 0)"""


def _hash_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")

    def rule(df, ident, desc):
        return df.select(ident.alias("rule_id"), F.lit(0).alias("rule_type"), F.md5("text").alias("rule_content"), F.lit(desc).alias("rule_desc"), ident.alias("ord"))

    return rule(d.where("doc_id % 97 = 0"), F.col("doc_id"), "").unionByName(rule(b, F.col("item_id") + 1000000, "decoy")).unionByName(
        rule(d.where("doc_id % 194 = 0"), F.col("doc_id") + 5000000, "later"))


@query(f"SELECT d.doc_id, r.rule_id, md5(d.text) AS digest, CASE WHEN r.rule_id >= 5000000 THEN 'later' WHEN r.rule_id >= 1000000 THEN 'decoy' ELSE 'MD5 hash rule' END AS rule_desc, 4::BIGINT AS level FROM documents d JOIN (SELECT digest, max(rule_id) AS rule_id FROM {_HASH_RULES_SQL} GROUP BY digest) r ON md5(d.text) = r.digest WHERE length(d.text) > 0")
def hash_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    found = hashing.hash_hits(d, _hash_rules(spark, sf_dir), ["doc_id"], types=(hashing.MD5,))
    return found.select("doc_id", "hit.rule_id", F.col("hit.matched").alias("digest"), "hit.rule_desc", F.col("hit.level").cast("bigint").alias("level"))


@query(f"SELECT digest, max(rule_id) AS rule_id, count(*) AS rules FROM {_HASH_RULES_SQL} GROUP BY digest HAVING count(*) > 1")
def hash_rule_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _hash_rules(spark, sf_dir)
    last = keywords.last_rules(rules, ["rule_type", "rule_content"]).select(F.col("rule_content").alias("digest"), "rule_id")
    n = rules.groupBy(F.col("rule_content").alias("digest")).agg(F.count("*").alias("rules")).where("rules > 1")
    return last.join(n, "digest").select("digest", "rule_id", "rules")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.duplicate_contents(table(spark, sf_dir, "documents"), "text", "doc_id")


_FACT_NAMES = list(features.FACTS)
_BOTH_SQL = lambda inner: f"SELECT * FROM ({inner('documents', LATIN, 'doc_id')}) UNION ALL SELECT * FROM ({inner(golden_sql(OFFICIALS), OFFICIAL, '-1 - doc_id AS doc_id')})"


def _both(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    g = golden(spark, OFFICIALS).withColumn("doc_id", -1 - F.col("doc_id"))
    return f(features.facts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LATIN)).unionByName(f(features.facts(g, "text", OFFICIAL)))


def _inner(select: str):
    return lambda source, pack, keep: f"SELECT {select} FROM ({sql.facts(source, 'text', pack, keep)})"


@query(_BOTH_SQL(_inner(", ".join(["doc_id", *_FACT_NAMES]))))
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda d: d.select("doc_id", *_FACT_NAMES))


_COUNTS = "doc_id, text_length::BIGINT AS text_length, " + ", ".join(f"len({k}) AS n_{k}" for k in KEYWORD_ORDER) + ", pattern_matches::BIGINT AS pattern_matches, keyword_matches::BIGINT AS keyword_matches, positive_count::BIGINT AS positive_count, has_critical, round(prohibited_ratio, 6) AS prohibited_ratio"


@query(_BOTH_SQL(_inner(_COUNTS)))
def doc_feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda d: d.select(
        "doc_id", *longs("text_length"), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KEYWORD_ORDER], *longs("pattern_matches", "keyword_matches", "positive_count"),
        "has_critical", F.round("prohibited_ratio", 6).alias("prohibited_ratio")))


_TOTAL = sql.adjusted(sql.text_score(), False)


@query(_BOTH_SQL(_inner(f"doc_id, round({sql.text_score()}, 6) AS text_score, round({_TOTAL}, 6) AS total_score")))
def doc_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda d: score.scored(d).select("doc_id", F.round("text_score", 6).alias("text_score"), F.round("total_score", 6).alias("total_score")))


@query(_BOTH_SQL(_inner(f"doc_id, {_TOTAL} >= 0.6::DOUBLE AS is_official, {sql.confidence(_TOTAL)} AS confidence")))
def doc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, lambda d: score.scored(d).select("doc_id", "is_official", "confidence"))


@query(f"SELECT confidence, count(*) AS n FROM ({_BOTH_SQL(_inner(f'{sql.confidence(_TOTAL)} AS confidence'))}) GROUP BY confidence")
def doc_confidence_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.histogram(_both(spark, sf_dir, lambda d: score.scored(d).select("confidence")), F.col("confidence"), "confidence")


def _quick_sql(pack: Pack) -> str:
    signs = [f"({sql.first('text', pack.patterns[n])} <> '')::INT" for n in ("doc_number", "title", "issue_date")] + [f"(len({sql.matched('lower(text)', pack.keywords[k])}) > 0)::INT" for k in ("org", "doctype")]
    return f"strlen(text) >= 100 AND ({' + '.join(signs)}) >= 2"


@query(f"SELECT doc_id, {_quick_sql(LATIN)} AS likely FROM documents UNION ALL SELECT -1 - doc_id, {_quick_sql(OFFICIAL)} FROM {golden_sql(OFFICIALS)}")
def doc_quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda d, pack: d.select("doc_id", features.quick_check(F.col("text"), pack).alias("likely"))
    return one(table(spark, sf_dir, "documents"), LATIN).unionByName(one(golden(spark, OFFICIALS).withColumn("doc_id", -1 - F.col("doc_id")), OFFICIAL))


@query(f"SELECT doc_id, preset, is_official FROM ({' UNION ALL '.join(f'SELECT doc_id, {sql.q(p)} AS preset, {sql.adjusted(sql.text_score(w), False)} >= {w.threshold!r}::DOUBLE AS is_official FROM f' for p, w in score.PRESETS.items())})".replace("SELECT doc_id, preset", f"WITH f AS ({sql.facts('documents', 'text', LATIN, 'doc_id')}) SELECT doc_id, preset", 1))
def preset_sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets in one pass over the documents."""
    d = features.facts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", LATIN)

    def verdict(w: score.Weights) -> Column:
        total = score.text_score(w)
        for part in score.adjustments().values():
            total = total + part
        return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)) >= w.threshold

    each = F.array(*[F.struct(F.lit(p).alias("preset"), verdict(w).alias("is_official")) for p, w in score.PRESETS.items()])
    return d.select("doc_id", F.explode(each).alias("v")).select("doc_id", "v.preset", "v.is_official")


def _layouts(spark: SparkSession) -> DataFrame:
    cols = ["name", "doc_number", "title", "issue_date", "copy_number", "text_length", *_STYLE, "is_image"]
    kinds = ["string"] * 5 + ["int"] + ["boolean"] * 11
    d = spark.createDataFrame(list(LAYOUTS), ", ".join(f"{c} {k}" for c, k in zip(cols, kinds)))
    empty = {f: F.lit("") for f in ("secret_level", "urgency", "issuer", "title_type", "main_send", "attachment", "copy_to", "print_info")}
    d = d.withColumns(empty | {k: F.array().cast("array<string>") for k in KEYWORD_ORDER})
    reasons = F.when(F.col("is_image"), F.array(F.lit(score.IMAGE_REASON))).otherwise(F.array().cast("array<string>"))
    return d.withColumn("style", F.struct(*_STYLE, reasons.alias("style_reasons")))


def _layout_values() -> str:
    lit = lambda v: str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else sql.q(v)
    names = ", ".join(["name", "doc_number", "title", "issue_date", "copy_number", "text_length", *_STYLE, "is_image"])
    empty = ", ".join([f"'' AS {f}" for f in ("secret_level", "urgency", "issuer", "title_type", "main_send", "attachment", "copy_to", "print_info")] + [f"[]::VARCHAR[] AS {k}" for k in KEYWORD_ORDER])
    return f"(SELECT *, {empty} FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in LAYOUTS) + f") v({names}))"


_SHOWN = " OR ".join(score.STYLE_SHOWN)
_JOINED = f"CASE WHEN {_SHOWN} THEN {sql.text_score()} * 0.55::DOUBLE + {sql.style_score()} * 0.45::DOUBLE ELSE {sql.text_score()} END"


@query(f"SELECT name, round({sql.style_score()}, 6) AS style_score, round({sql.adjusted(_JOINED, True)}, 6) AS total_score, {sql.confidence(sql.adjusted(_JOINED, True))} AS confidence FROM {_layout_values()}")
def style_score_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(_layouts(spark), style="style").select("name", F.round("style_score", 6).alias("style_score"), F.round("total_score", 6).alias("total_score"), "confidence")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the hits of three detectors and the first of them."""
    d = score.scored(features.facts(table(spark, sf_dir, "documents"), "text", LATIN))
    m, level = markers.strict(F.col("text"), LATIN)
    marker = markers.hit(m != "", level, F.lit(2001), F.lit("marker"), tx.trim(m), F.lit(""), alerts.MARKER_ALERT)
    kw = markers.hit(F.contains(F.lower("text"), F.lit("license")), F.lit(4), F.lit(4001), F.lit("keyword"), F.lit("license"), F.lit(""), 5)
    return once(d, {"hit": alerts.first_hit(marker=marker, layout=alerts.layout_hit(), keyword=kw)})


_M = sql.first("text", LATIN.strict_marker)
_DETECTED_SQL = f"""(SELECT doc_id, source, lang, text, CASE WHEN {_M} <> '' THEN 2001 WHEN total >= 0.6::DOUBLE THEN 3001 WHEN contains(lower(text), 'license') THEN 4001 END AS rule_id,
 CASE WHEN {_M} <> '' THEN ({sql.level(sql.first('text', LATIN.strict_marker, 1), LATIN)}) WHEN total >= 0.6::DOUBLE THEN 4 WHEN contains(lower(text), 'license') THEN 4 END AS level,
 CASE WHEN {_M} <> '' THEN {sql.trim(_M)} WHEN total >= 0.6::DOUBLE THEN array_to_string(list_filter([doc_number, title, issue_date], lambda x: x <> ''), ' | ') WHEN contains(lower(text), 'license') THEN 'license' END AS matched,
 CASE WHEN {_M} <> '' THEN 2 WHEN total >= 0.6::DOUBLE THEN 3 WHEN contains(lower(text), 'license') THEN 5 END AS alert_type
 FROM (SELECT *, {_TOTAL} AS total FROM ({sql.facts('documents', 'text', LATIN, 'doc_id, source, lang, text')})))"""


@query(f"SELECT doc_id, rule_id::BIGINT AS rule_id, level::BIGINT AS level, matched FROM {_DETECTED_SQL} WHERE rule_id IS NOT NULL")
def first_hit_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).where("hit is not null").select("doc_id", "hit.rule_id", F.col("hit.level").cast("bigint").alias("level"), "hit.matched")


_LEVELS = "list_filter([CASE WHEN contains(low, 'password') THEN 'secret' END, CASE WHEN contains(low, 'license') THEN 'internal' END, CASE WHEN contains(low, '@') THEN 'confidential' END, 'none'], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, CASE WHEN list_contains(l, 'secret') THEN 'secret' WHEN list_contains(l, 'confidential') THEN 'confidential' WHEN list_contains(l, 'internal') THEN 'internal' ELSE 'none' END AS level FROM (SELECT doc_id, {_LEVELS} AS l FROM (SELECT doc_id, lower(text) AS low FROM documents))")
def max_level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    levels = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), n) for w, n in (("password", "secret"), ("license", "internal"), ("@", "confidential"))], F.lit("none")))
    return table(spark, sf_dir, "documents").select("doc_id", alerts.merged_level(levels).alias("level"))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return alerts.alert_records(_detected(spark, sf_dir), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(7)).cast("int")).cast("string"), path, name, F.col("text").cast("binary"))


_ALERTS_SQL = f"""(SELECT left(sha256(md5(text) || '|' || '/' || source || '/' || doc_id || '.txt' || '|' || rule_id), 20) AS id, (DATE '2024-01-01' + (doc_id % 7)::INT)::VARCHAR AS time,
 rule_id, level, alert_type, {sql.cut_bytes('matched', 512)} AS highlight_text, '/' || source || '/' || doc_id || '.txt' AS file_path, md5(text) AS file_md5, octet_length(encode(text)) AS file_size FROM {_DETECTED_SQL} WHERE rule_id IS NOT NULL)"""


@query(f"SELECT id, left(time, 10) AS time, rule_id::BIGINT AS rule_id, level::BIGINT AS file_level, alert_type::BIGINT AS alert_type, highlight_text, file_path, file_md5, file_size::BIGINT AS file_size FROM {_ALERTS_SQL}")
def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select("id", "time", "rule_id", *longs("file_level", "alert_type"), "highlight_text", "file_path", "file_md5", "file_size")


@query(f"SELECT left(time, 10) AS day, count(*) AS alerts, count(DISTINCT file_md5) AS files, array_to_string(list_sort(list(DISTINCT level::VARCHAR)), ',') AS levels FROM {_ALERTS_SQL} GROUP BY 1")
def alert_log_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_log(_alerts(spark, sf_dir), F.col("time"))


_ORIGIN_SQL = f"{sql.cut_bytes("repeat('é' || source, 100)", 256)} AS company, {sql.cut_bytes("repeat('/' || source, 200)", 512)} AS org_path, 'user' || (doc_id % 10) AS user_id"


@query(f"""SELECT left(sha256(md5(text) || '|' || '/' || source || '|4001'), 20) AS id, {_ORIGIN_SQL}, {sql.cut_bytes('text', 65535)} AS file_summary, NULL::VARCHAR AS computer_name,
 NULL::VARCHAR AS org_id, NULL::VARCHAR AS user_name, '{{"lang":"' || lang || '"}}' AS extend_fields, 1::BIGINT AS filter_type
 FROM documents WHERE contains(lower(text), 'license')""")
def alert_origin_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hit = markers.hit(F.contains(F.lower("text"), F.lit("license")), F.lit(4), F.lit(4001), F.lit("keyword"), F.lit("license"), F.lit(""), 5)
    origin = {
        "company": F.repeat(F.concat(F.lit("é"), "source"), F.lit(100)), "org_path": F.repeat(F.concat(F.lit("/"), "source"), F.lit(200)), "file_summary": F.col("text"),
        "user_id": F.concat(F.lit("user"), (F.col("doc_id") % 10).cast("string")), "extend_fields": F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')),
    }
    path = F.concat(F.lit("/"), "source")
    records = alerts.alert_records(d.withColumn("hit", hit), F.lit("2024-01-01"), path, path, F.col("text").cast("binary"), origin=origin)
    return records.select("id", *alerts.ORIGIN, *longs("filter_type"))


# Files made of documents: text as it is, office files with and without extracted text, images, other bytes.
_FILE_HEADS = ("", "504B0304", "504B0304", "FFD8FF", "00")
_FILES_SQL = "(SELECT *, CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(_FILE_HEADS)) + " END || hex(encode(text)) AS hexa FROM {source} WHERE text IS NOT NULL)"


def _files(df: DataFrame) -> DataFrame:
    heads = F.array(*[F.lit(bytes.fromhex(h)) for h in _FILE_HEADS])
    n = F.pmod("doc_id", F.lit(5)).cast("int")
    content = F.concat(F.get(heads, n), F.col("text").cast("binary"))
    return df.where("text is not null").select("doc_id", content.alias("content"), F.when(n == 1, F.col("text")).alias("extracted"))


def _dispatch_sql(source: str, pack: Pack) -> str:
    edge = lambda x: f"decode(unhex({x}), 'replace')"  # noqa: E731  (a window may cut a character)
    head, tail = "hexa[1:8192]", "CASE WHEN length(hexa) > 8192 THEN hexa[greatest(8192, length(hexa) - 4096) + 1:] ELSE '' END"
    odd = "'^(..)*?(0[0-8BCEF]|1.)'"
    kind = f"CASE WHEN doc_id % 5 IN (1, 2) THEN 'office' WHEN doc_id % 5 = 3 THEN 'image' WHEN length(hexa) >= 514 AND NOT regexp_matches(hexa[1:514], {odd}) THEN 'text' ELSE 'binary' END"
    label, level = sql.byte_scan("hexa[1:2097152]", pack)
    p = pack.strict_marker
    m = {k: sql.first(k, p) for k in ("text", "h", "t")}
    n = {k: sql.level(sql.first(k, p, 1), pack) for k in ("text", "h", "t")}
    rows = f"(SELECT doc_id, text, {kind} AS kind, {edge(head)} AS h, {edge(tail)} AS t, {label} AS label, {level} AS blevel FROM {_FILES_SQL.format(source=source)})"
    matched = f"CASE WHEN kind = 'office' AND doc_id % 5 = 1 THEN {m['text']} WHEN kind = 'text' THEN CASE WHEN {m['h']} <> '' THEN {m['h']} ELSE {m['t']} END WHEN kind = 'image' THEN '' ELSE label END"
    lev = f"CASE WHEN kind = 'office' AND doc_id % 5 = 1 THEN {n['text']} WHEN kind = 'text' THEN CASE WHEN {m['h']} <> '' THEN {n['h']} ELSE {n['t']} END ELSE blevel END"
    return f"SELECT {sql.q(pack.name)} AS pack, doc_id, {sql.trim('matched')} AS matched, (CASE WHEN lev = 0 THEN 4 ELSE lev END)::BIGINT AS level, {sql.q(dispatch.DESC)} || {sql.trim('matched')} AS rule_desc FROM (SELECT doc_id, {matched} AS matched, {lev} AS lev FROM {rows}) WHERE {sql.trim('matched')} <> ''"


@query(_dispatch_sql(golden_sql(MARKERS), OFFICIAL) + " UNION ALL " + _dispatch_sql("documents", LATIN))
def marker_dispatch_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    def found(df: DataFrame, pack: Pack) -> DataFrame:
        d = _files(df).withColumn("hit", dispatch.marker_hit(F.col("content"), F.col("extracted"), pack)).where("hit is not null")
        return d.select(F.lit(pack.name).alias("pack"), "doc_id", "hit.matched", F.col("hit.level").cast("bigint").alias("level"), "hit.rule_desc")

    return found(golden(spark, MARKERS), OFFICIAL).unionByName(found(table(spark, sf_dir, "documents"), LATIN))


_KIND_NAMES = ("a.md", "b.pdf", "c", "d.JPG", "e.bin")


@query("""SELECT doc_id, kind, CASE WHEN kind IN ('image', 'document') THEN kind END AS electronic FROM (SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN 'image' WHEN 1 THEN 'archive' WHEN 2 THEN 'archive'
 WHEN 0 THEN 'text' ELSE 'other' END AS kind FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) > 0 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))""")
def detector_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    d = _files(table(spark, sf_dir, "documents").where((F.octet_length("text") > 0) & ~odd))
    name = F.get(F.array(*map(F.lit, _KIND_NAMES)), F.pmod("doc_id", F.lit(5)).cast("int"))
    return d.select("doc_id", sniff.detector_type(F.col("content"), name).alias("kind"), dispatch.electronic_input(F.col("content"), name).alias("electronic"))


_SUMMARY_SQL = ", ".join([f"{{'key': '{n}', 'value': ({f} <> '')::VARCHAR}}" for n, f in features.SUMMARY] + [
    "{'key': 'title_type', 'value': title_type}", "{'key': 'has_org_name', 'value': (len(org) > 0)::VARCHAR}", "{'key': 'org_count', 'value': len(org)::VARCHAR}",
    "{'key': 'pattern_matches', 'value': pattern_matches::BIGINT::VARCHAR}", "{'key': 'keyword_matches', 'value': keyword_matches::BIGINT::VARCHAR}",
    "{'key': 'prohibit_words_count', 'value': len(prohibited)::VARCHAR}"])


@query(f"SELECT doc_id, s.key AS key, s.value AS value FROM (SELECT doc_id, unnest([{_SUMMARY_SQL}]) AS s FROM ({sql.facts('documents', 'text', LATIN, 'doc_id')}))")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = features.facts(table(spark, sf_dir, "documents"), "text", LATIN)
    return d.select("doc_id", F.explode(features.summary()).alias("key", "value"))


_SCAN = f"(SELECT source, lang, length(text) = 0 OR octet_length(encode(text)) < 50 AS bad, {_M} <> '' AS found, octet_length(encode(text)) AS n FROM documents)"


@query(f"SELECT source, count(*) AS total, count(*) FILTER (bad) AS errors, count(*) FILTER (NOT bad AND found) AS detected, count(*) FILTER (NOT bad AND NOT found) AS missed, sum(n)::BIGINT AS bytes FROM {_SCAN} GROUP BY source")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return reports.scan_summary(table(spark, sf_dir, "documents"), n < 50, markers.strict(F.col("text"), LATIN)[0] != "", n, ["source"])


@query(f"SELECT count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok AND o) AS official, count(*) FILTER (ok AND NOT o) AS other FROM (SELECT text_length >= 50 AS ok, {_TOTAL} >= 0.6::DOUBLE AS o FROM ({sql.facts('documents', 'text', LATIN, 'doc_id')}))")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score.scored(features.facts(table(spark, sf_dir, "documents"), "text", LATIN))
    return reports.batch_summary(d, F.col("text_length") >= 50, F.col("is_official"))


@query(f"SELECT source, lang, count(*) AS n, count(DISTINCT rule_id) AS rules FROM {_DETECTED_SQL} WHERE rule_id IS NOT NULL GROUP BY source, lang")
def hits_by_source_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).where("hit is not null").groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("hit.rule_id").alias("rules"))


_IP = LATIN.patterns["print_info"]
WHITELIST = ("10.0.0.0/8", "192.168.0.0/16", "127.0.0.1", "100.64.0.0/10", "1.2.3.4")
_CONN = f"(SELECT doc_id, {sql.first('text', _IP)} AS remote_ip FROM documents WHERE {sql.first('text', _IP)} <> '')"


def _ip_sql(ip: str) -> str:
    o = [f"split_part({ip}, '.', {k})::BIGINT" for k in range(1, 5)]
    return f"CASE WHEN greatest({', '.join(o)}) <= 255 THEN {o[0]} * 16777216 + {o[1]} * 65536 + {o[2]} * 256 + {o[3]} END"


def _ranges_sql() -> str:
    import ipaddress

    nets = [ipaddress.ip_network(w) for w in WHITELIST]
    return "(VALUES " + ", ".join(f"({int(n.network_address)}::BIGINT, {int(n.broadcast_address)}::BIGINT)" for n in nets) + ") r(lo, hi)"


_BAD = f"(SELECT doc_id, remote_ip FROM (SELECT *, {_ip_sql('remote_ip')} AS n FROM {_CONN}) c WHERE remote_ip NOT IN ('0.0.0.0', '127.0.0.1') AND NOT EXISTS (SELECT 1 FROM {_ranges_sql()} WHERE c.n BETWEEN lo AND hi))"


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = table(spark, sf_dir, "documents").select("doc_id", features.first(F.col("text"), LATIN, "print_info").alias("remote_ip")).where("remote_ip <> ''")
    return net.violations(conn, spark.createDataFrame([(w,) for w in WHITELIST], "entry string"))


@query(f"SELECT * FROM {_BAD}")
def ip_whitelist_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _violations(spark, sf_dir)


@query(f"SELECT remote_ip, min(doc_id) AS doc_id FROM {_BAD} GROUP BY remote_ip")
def net_first_alert_per_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.first_alerts(_violations(spark, sf_dir), "remote_ip", ["doc_id"]).select("remote_ip", "doc_id")


_IP6 = "'2001:db8:' || substr(md5({k}), 1, 4) || ':' || substr(md5({k}), 5, 4)"
_IP4 = "({k} % 223 + 1) || '.' || ({k} % 251)"
_EVENT_IPS = f"SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN {_IP4.format(k='user_id')} || '.' || (event_id % 7) || '.' || (event_id % 13) ELSE {_IP6.format(k='user_id::VARCHAR')} || '::' || substr(md5(event_id::VARCHAR), 1, 4) END AS remote_ip FROM events"
_PREFIXES = """SELECT CASE c_custkey % 4 WHEN 0 THEN '6' || substr(md5(c_custkey::VARCHAR), 1, 4) WHEN 1 THEN '6' || substr(md5(c_custkey::VARCHAR), 1, 8)
 WHEN 2 THEN '4' || (c_custkey % 223 + 1) || '.' || (c_custkey % 251) || '.' ELSE '4' || (c_custkey % 223 + 1) || '.' || (c_custkey % 251) || '.' || (c_custkey % 7) || '.' || (c_custkey % 13) || '$' END AS p FROM customer"""


@query(f"""WITH e AS ({_EVENT_IPS}), p AS ({_PREFIXES}), h AS (SELECT *, substr(md5(user_id::VARCHAR), 1, 8) AS x, '4' || split_part(remote_ip, '.', 1) || '.' || split_part(remote_ip, '.', 2) || '.' AS two FROM e)
 SELECT event_id, remote_ip FROM h WHERE CASE WHEN event_id % 2 = 0 THEN two NOT IN (SELECT p FROM p) AND '4' || remote_ip || '$' NOT IN (SELECT p FROM p)
 ELSE '6' || x[1:4] NOT IN (SELECT p FROM p) AND '6' || x NOT IN (SELECT p FROM p) END""")
def ip_prefix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of both families, made of events, against a whitelist of blocks made of customers."""
    k = lambda c: F.md5(F.col(c).cast("string"))
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    six = lambda c, n: cat("2001:db8:", F.substring(k(c), 1, 4), *([":", F.substring(k(c), 5, 4)] if n == 2 else []))
    four = lambda c: cat(F.col(c) % 223 + 1, ".", F.col(c) % 251)
    e, c = table(spark, sf_dir, "events"), F.col("c_custkey")
    conn = e.select("event_id", F.when(F.col("event_id") % 2 == 0, cat(four("user_id"), ".", F.col("event_id") % 7, ".", F.col("event_id") % 13)).otherwise(cat(six("user_id", 2), "::", F.substring(k("event_id"), 1, 4))).alias("remote_ip"))
    entry = F.when(c % 4 == 0, cat(six("c_custkey", 1), "::/48")).when(c % 4 == 1, cat(six("c_custkey", 2), "::/64")).when(c % 4 == 2, cat(four("c_custkey"), ".0.0/16")).otherwise(cat(four("c_custkey"), ".", c % 7, ".", c % 13))
    return net.violations(conn, table(spark, sf_dir, "customer").select(entry.alias("entry")))


@query("SELECT 'protocol' AS kind, event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'status', (event_id % 3)::VARCHAR, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'addresses', 'distinct', count(DISTINCT user_id) FROM events")
def conn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("status", F.col("event_id") % 3)
    return net.connection_stats(e, "event_type", "status", "user_id")


@query("""SELECT code, coalesce(code = 1002, false) AS recoverable, attempt, count(*) AS n FROM (
 SELECT CASE WHEN text IS NULL OR text = '' THEN 2001 WHEN length(text) > 20000 THEN 2002 WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 5002
   WHEN doc_id % 9 = 0 AND doc_id % 5 >= 3 THEN 1002 END AS code,
  CASE WHEN text IS NULL OR text = '' OR length(text) > 20000 OR NOT regexp_matches(text, '[A-Za-z]') OR doc_id % 9 <> 0 THEN 1
   ELSE least(doc_id % 5 + 1, 3) END::INT AS attempt FROM documents) GROUP BY ALL""")
def failures_after_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that documents end with: some fail for good, every ninth is given a timeout for its first doc_id % 5 attempts."""

    def process(rows: DataFrame, attempt: int) -> DataFrame:
        c, t = failures.CODES, F.col("text")
        code = F.when(t.isNull() | (t == ""), c["file_empty"]).when(F.length(t) > 20_000, c["file_too_large"])
        code = code.when(~F.rlike(t, F.lit("[A-Za-z]")), c["invalid_content"])
        return rows.withColumn("code", code.when((F.col("doc_id") % 9 == 0) & (F.col("doc_id") % 5 >= attempt), c["timeout"]))

    return failures.by_code(failures.attempted(table(spark, sf_dir, "documents").select("doc_id", "text"), process))


@query("""WITH c AS (SELECT event_id % 12 AS batch, (user_id % 223 + 1) || '.0.0.' || (user_id % 50) AS ip, user_id % 223 + 1 AS head FROM events),
 n AS (SELECT batch, count(*) AS k FROM c GROUP BY batch),
 s AS (SELECT batch, count(*) AS a FROM (SELECT ip, min(batch) AS batch FROM c WHERE head NOT BETWEEN 16 AND 31 AND ip <> '127.0.0.1' GROUP BY ip) GROUP BY batch),
 i AS (SELECT event_id % 12 AS batch, count(*) AS k, count(*) FILTER (WHERE event_id % 5 = 0 OR event_id % 7 <> c_custkey % 7) AS a
  FROM events JOIN customer ON user_id = c_custkey GROUP BY 1),
 b AS (SELECT 'network' AS monitor, batch, k, coalesce(a, 0) AS a FROM n LEFT JOIN s USING (batch) UNION ALL SELECT 'integrity', batch, k, a FROM i)
SELECT monitor, batch, count(*) OVER w AS scans, (sum(k) OVER w)::BIGINT AS checked, (sum(a) OVER w)::BIGINT AS alerts FROM b
WINDOW w AS (PARTITION BY monitor ORDER BY batch)""")
def monitor_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counters of the network and the integrity monitor over batches of events."""
    e = table(spark, sf_dir, "events").withColumn("batch", F.col("event_id") % 12)
    conn = e.select("batch", F.concat(F.col("user_id") % 223 + 1, F.lit(".0.0."), F.col("user_id") % 50).alias("remote_ip"))
    allowed = spark.createDataFrame([("16.0.0.0/4",)], "entry string")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.md5((F.col("c_custkey") % 7).cast("string")).alias("digest"))
    digest = F.when(F.col("event_id") % 5 != 0, F.md5((F.col("event_id") % 7).cast("string")))
    files = e.select("batch", F.col("user_id").alias("path"), digest.alias("digest")).join(known.select("path"), "path", "left_semi")
    net_ = monitor.totals(monitor.counted(conn), monitor.network_seen(conn, allowed), once=True)
    own = monitor.totals(monitor.counted(files), monitor.integrity_seen(files, known), once=False)
    return net_.select(F.lit("network").alias("monitor"), "*").unionByName(own.select(F.lit("integrity").alias("monitor"), "*"))


@query("SELECT coalesce(b.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS state FROM (SELECT doc_id AS path, md5(text) AS d FROM documents WHERE doc_id % 5 <> 0) b FULL JOIN (SELECT doc_id AS path, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS d FROM documents WHERE doc_id % 11 <> 0) n ON b.path = n.path WHERE b.path IS NULL OR n.path IS NULL OR b.d <> n.d")
def integrity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    before = integrity.baseline(d.where("doc_id % 5 <> 0"), "doc_id", F.md5("text"))
    now = integrity.baseline(d.where("doc_id % 11 <> 0"), "doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return integrity.drift(before, now)


POLICY_OPS = (
    ("hash", 1, "add", 1, "aa"), ("hash", 1, "add", 2, "bb"), ("hash", 2, "del", 1, None), ("hash", 3, "add", 3, "cc"), ("hash", 4, "add", 2, "b2"),
    ("keyword", 1, "add", 7, "x AND y"), ("keyword", 2, "reset", 8, "z"), ("keyword", 3, "add", 9, "w"), ("keyword", 3, "del", 8, None), ("marker", 1, "add", 5, "m"), ("marker", 2, "reset", None, None),
)


_CMD_SQL = "CASE WHEN event_id % 499 = 0 THEN 'reset' WHEN event_id % 5 = 0 THEN 'del' ELSE 'add' END"
_OPS_SQL = f"""(SELECT event_type AS module, event_id AS version, {_CMD_SQL} AS cmd, CASE WHEN event_id % 998 <> 0 THEN user_id % 40 END AS rule_id,
 CASE WHEN {_CMD_SQL} <> 'del' AND event_id % 998 <> 0 THEN 'c' || (event_id % 17) END AS rule_content FROM events)"""


def _policy_ops(events: DataFrame) -> DataFrame:
    """Operations on rules made of events; a few reset their module to one rule or to none."""
    cmd = F.when(F.col("event_id") % 499 == 0, "reset").when(F.col("event_id") % 5 == 0, "del").otherwise("add")
    some = F.col("event_id") % 998 != 0
    content = F.when((cmd != "del") & some, F.concat(F.lit("c"), (F.col("event_id") % 17).cast("string")))
    return events.select(F.col("event_type").alias("module"), F.col("event_id").alias("version"), cmd.alias("cmd"), F.when(some, F.col("user_id") % 40).cast("bigint").alias("rule_id"), content.alias("rule_content"))


_GOLDEN_OPS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else sql.q(v) if isinstance(v, str) else f"{v}::BIGINT" for v in op) + ")" for op in POLICY_OPS) + ") g(module, version, cmd, rule_id, rule_content)"


@query(f"""WITH ops AS (SELECT * FROM {_OPS_SQL} UNION ALL SELECT * FROM {_GOLDEN_OPS_SQL}), r AS (SELECT module, max(version) AS last FROM ops WHERE cmd = 'reset' GROUP BY module),
 k AS (SELECT module, rule_id, rule_content, version, cmd, row_number() OVER (PARTITION BY module, rule_id ORDER BY version DESC, cmd = 'del' DESC, coalesce(rule_content, '') DESC) AS n
 FROM ops LEFT JOIN r USING (module) WHERE rule_id IS NOT NULL AND (last IS NULL OR version >= last))
 SELECT module, rule_id, rule_content, version FROM k WHERE n = 1 AND cmd <> 'del'""")
def policy_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = spark.createDataFrame(list(POLICY_OPS), "module string, version long, cmd string, rule_id long, rule_content string")
    return policy.folded(_policy_ops(table(spark, sf_dir, "events")).unionByName(ops))


def _streamed(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream over given files writes, once all of them are read."""
    at = shared_dir(spark)
    with stateful.rocksdb(spark):
        streams.run_to(stream, streams.to_table(f"{at}/out"), f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query(f"""WITH ops AS (SELECT *, max(CASE WHEN cmd = 'reset' THEN version END) OVER (PARTITION BY module ORDER BY version) AS last FROM {_OPS_SQL}),
 x AS (SELECT *, lag(version) OVER w AS before, lag(cmd) OVER w AS what FROM ops WHERE rule_id IS NOT NULL WINDOW w AS (PARTITION BY module, rule_id ORDER BY version))
 SELECT module, cmd, cmd <> 'del' OR coalesce(what <> 'del' AND (last IS NULL OR before >= last), FALSE) AS ok, count(*) AS n FROM x GROUP BY ALL""")
def policy_stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations as a stream with the state of each module's rules: how many could be applied."""
    feed = streams.table_feed(spark, f"{sf_dir}/events.parque*", "event_id long, user_id long, event_type string", 1 << 30)
    done = _streamed(spark, stateful.policy_outcomes(_policy_ops(feed)))
    return done.groupBy("module", "cmd", "ok").agg(F.count("*").alias("n"))


_TICKS, _TICK_S, _WATCH_START = 4, 60, "2024-01-01 00:00:00"
_SEEN_SQL = "(doc_id + tick) % 5 <> 0"


@query(f"""SELECT tick, CASE WHEN NOT ({_SEEN_SQL}) THEN 'deleted' WHEN doc_id % 13 = 0 THEN 'added' WHEN doc_id % 11 = 0 AND tick = 2 THEN 'unreadable' ELSE 'modified' END AS state, count(*) AS n, sum(doc_id)::BIGINT AS ids
 FROM (SELECT doc_id, unnest(range(1, {_TICKS + 1})) AS tick FROM documents)
 WHERE CASE WHEN {_SEEN_SQL} THEN doc_id % 13 = 0 OR doc_id % 11 = 0 AND tick = 2 OR doc_id % 7 = tick ELSE doc_id % 13 <> 0 END GROUP BY 1, 2""")
def integrity_watch_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of documents, one a tick, as a stream: some are away, changed, unreadable or unknown to the baseline at some ticks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.md5("text").alias("digest"))
    start = F.lit(_WATCH_START).cast("timestamp")
    base = d.where("doc_id % 13 <> 0").select("path", "digest", start.alias("since"))
    at = shared_dir(spark)
    for tick in range(1, _TICKS + 2):  # one more, which tells that the last is over
        found = d.where((F.col("doc_id") + tick) % 5 != 0) if tick <= _TICKS else d.where("doc_id % 13 <> 0")
        digest = F.when((F.col("doc_id") % 11 == 0) & (tick == 2), None).when(F.col("doc_id") % 7 == tick, F.md5("digest")).otherwise(F.col("digest"))
        seen = found.select("path", (digest if tick <= _TICKS else F.col("digest")).alias("digest"), (start + F.make_dt_interval(secs=F.lit(float(tick * _TICK_S)))).alias("at"))
        seen.write.parquet(f"{at}/tick={tick}")
    feed = streams.ticks_feed(spark, at, "path string, digest string, at timestamp")
    alerts_of = _streamed(spark, stateful.integrity_watch(feed, base, _TICK_S * 1000))
    tick_of = ((F.unix_seconds("at") - F.unix_seconds(start)) / _TICK_S).cast("bigint")
    return alerts_of.select(tick_of.alias("tick"), "state", F.col("path").cast("bigint").alias("doc_id")).where(F.col("tick") <= _TICKS).groupBy("tick", "state").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


FILES = (("a.docx", "504B030414000600776F72642F646F63756D656E742E786D6C"), ("b.txt", "255044462D312E35"), ("c.pdf", "3C21444F43545950452068746D6C3E"), ("d.jpeg", "FFD8FFE0"), ("e.xyz", "FFD8FFE0"), ("f.txt", "68656C6C6F20776F726C64"), ("g.ofd", "504B03044F46442E786D6C"), ("h.png", "52494646000000005745425056503820"), ("i.wps", "D0CF11E0A1B11AE14B696E67736F6674"))
_FAKE = {"a.docx": ("docx", True), "b.txt": ("pdf", False), "c.pdf": ("html", False), "d.jpeg": ("jpg", True), "e.xyz": ("jpg", True), "f.txt": ("txt", True), "g.ofd": ("ofd", True), "h.png": ("webp", True), "i.wps": ("wps", True)}


@query("SELECT * FROM (VALUES " + ", ".join(f"({sql.q(n)}, {sql.q(e)}, {str(ok).upper()})" for n, (e, ok) in _FAKE.items()) + ") v(name, ext, fits)")
def fake_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(list(FILES), "name string, h string").select("name", F.unhex("h").alias("content"))
    d = d.withColumn("ext", sniff.file_type(F.col("content"), F.col("name")).getField("ext"))
    return d.select("name", "ext", sniff.extension_fits(F.col("ext"), sniff.extension(F.col("name"))).alias("fits"))


@query("""WITH c AS (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY doc_id, c)
 SELECT doc_id, round(share, 6) AS top_share, share > 0.15 AS is_garbage FROM (SELECT doc_id, CASE WHEN text = '' THEN 0.0::DOUBLE ELSE s END AS share
 FROM documents LEFT JOIN (SELECT doc_id, max(n)::DOUBLE / sum(n)::DOUBLE AS s FROM c GROUP BY doc_id) USING (doc_id))""")
def garbage_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.is_garbage(table(spark, sf_dir, "documents"), "doc_id", "text", 0.15).withColumn("top_share", F.round("top_share", 6))


_READABLE = "[A-Za-z0-9 \\t\\n\\r.,;:!?''\"()\\-\\x{4E00}-\\x{9FFF}，。；：！？（）]"


@query(f"SELECT doc_id, round(CASE WHEN length(text) = 0 THEN 0.0::DOUBLE ELSE (length(text) - length(regexp_replace(text, '{_READABLE}', '', 'g')))::DOUBLE / length(text) END, 6) AS ratio FROM documents")
def readability_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(style.readability(F.col("text")), 6).alias("ratio"))


_LINES = ("12", " 3 ", "12345", "- 1 -", "—— 4 ——", "a1", "", "1-2", "--7--", "1 2 3")


@query(f"SELECT doc_id, {sql.page_marker('text')} AS is_marker FROM {golden_sql(_LINES)} UNION ALL SELECT doc_id + 100, {sql.page_marker('line')} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def page_marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") + 100).alias("doc_id"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return golden(spark, _LINES).unionByName(lines).select("doc_id", tx.is_page_marker(F.col("text")).alias("is_marker"))


_PAGE_LINES = 12
_PDF_LINES = ("中 文 file  name 3 a\n– 12 –\n17\n第一句。第二句！”他说。\n末", "a \n b\t c", "十。\n１２\n12345")


def _paged(text: Column) -> Column:
    """A text as pages of so many lines."""
    lines = F.split(text, "\n", -1)
    last = F.floor((F.size(lines) - 1) / _PAGE_LINES).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(lines, i * _PAGE_LINES + 1, F.lit(_PAGE_LINES)), "\n"))


def _pdfs(df: DataFrame) -> DataFrame:
    """PDF files of documents; every other one with compressed objects."""

    @F.pandas_udf("binary")
    def made(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([pdf.to_pdf(list(t), i % 2 == 0) for t, i in zip(texts, ids)])

    return df.where("text is not null").select("doc_id", made(_paged(F.col("text")), F.col("doc_id")).alias("content"))


@query(f"""SELECT doc_id, (len(string_split(text, chr(10))) + {_PAGE_LINES - 1}) // {_PAGE_LINES} AS pages, md5(text) AS text_md5, md5({sql.line_text('text')}) AS lines_md5
 FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id - 100, text FROM {golden_sql(_PDF_LINES)})""")
def pdf_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files, read through their cross-references, page trees and character maps."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(golden(spark, _PDF_LINES).withColumn("doc_id", F.col("doc_id") - 100))
    read = pdf.pages(_pdfs(d), keep=("doc_id",))
    whole = F.array_join("pages", "\n")
    return read.select("doc_id", F.size("pages").cast("bigint").alias("pages"), F.md5(whole).alias("text_md5"), F.md5(pdf.line_text(whole)).alias("lines_md5"))


#: A pack whose marker words occur in documents without Han characters.
_PDF_PACK = replace(LATIN, strict_marker=r"(license|Licensed|@[a-z]+)[^.\n]{0,20}")


def _pages_sql(pack: Pack) -> str:
    """(doc_id, matched, level) of the first of the first five pages with a strict marker."""
    p, page = pack.strict_marker, f"array_to_string(string_split(text, chr(10))[i * {_PAGE_LINES} + 1:i * {_PAGE_LINES} + {_PAGE_LINES}], chr(10))"
    rows = f"SELECT doc_id, i, {page} AS page FROM (SELECT doc_id, text, unnest(range(5)) AS i FROM documents)"
    hits = f"SELECT doc_id, i, {sql.trim(sql.first('page', p))} AS m, {sql.level(sql.first('page', p, 1), pack)} AS l FROM ({rows})"
    return f"(SELECT doc_id, m || ' (Page ' || (i + 1) || ')' AS matched, l::BIGINT AS level FROM ({hits}) WHERE m <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)"


@query(f"""SELECT d.doc_id, {sql.q(dispatch.DESC)} || matched AS rule_desc, matched AS highlight_text, (CASE WHEN level = 0 THEN 4 ELSE level END)::BIGINT AS file_level, 'pdf/' || d.doc_id || '.pdf' AS file_path, 2::BIGINT AS alert_type
 FROM documents d JOIN {_pages_sql(_PDF_PACK)} p ON d.doc_id = p.doc_id""")
def pdf_file_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files to alerts: type of the bytes, pages, marker by page, alert record."""
    return _pdf_alerts(spark, sf_dir).select("doc_id", "rule_desc", "highlight_text", *longs("file_level"), "file_path", *longs("alert_type"))


def _pdf_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _pdfs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    read = pdf.pages(files.withColumn("bytes", F.col("content")), keep=("doc_id", "bytes"))
    hit = dispatch.marker_hit(F.col("bytes"), F.lit(None).cast("string"), _PDF_PACK, pages=F.col("pages"))
    path = F.concat(F.lit("pdf/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    found = once(read, {"hit": hit}).where("hit is not null")
    records = alerts.alert_records(found, F.lit("2024-01-01 00:00:00"), path, name, F.col("bytes"))
    return records.withColumn("doc_id", F.regexp_extract("file_name", r"^(-?\d+)", 1).cast("bigint"))


COLORS = ("FF0000", "#c00000", "B43C50", "B40051", "00FF00", "red", "b20000", "12345", "")


@query("SELECT * FROM (VALUES ('FF0000', TRUE), ('#c00000', TRUE), ('B43C50', TRUE), ('B40051', FALSE), ('00FF00', FALSE), ('red', TRUE), ('b20000', FALSE), ('12345', FALSE), ('', FALSE)) v(color, is_red)")
def red_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in COLORS], "color string").select("color", style.is_red(F.col("color")).alias("is_red"))


@query("SELECT round(w, 1) AS width, w BETWEEN 208 AND 212 AND h BETWEEN 295 AND 299 AS a4, CASE WHEN p BETWEEN 8.5 AND 9.5 THEN '小五' WHEN p BETWEEN 10 AND 11 THEN '五号' WHEN p BETWEEN 11.5 AND 12.5 THEN '小四' WHEN p BETWEEN 13.5 AND 14.5 THEN '四号' WHEN p BETWEEN 14.5 AND 15.5 THEN '小三' WHEN p BETWEEN 15.5 AND 16.5 THEN '三号' ELSE '' END AS size_name FROM (VALUES (210.0::DOUBLE, 297.0::DOUBLE, 14.5::DOUBLE), (212.5, 297, 16), (208, 299, 20), (210, 290, 12.5), (100, 100, 9.2)) v(w, h, p)")
def page_and_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(210.0, 297.0, 14.5), (212.5, 297.0, 16.0), (208.0, 299.0, 20.0), (210.0, 290.0, 12.5), (100.0, 100.0, 9.2)], "w double, h double, p double")
    return d.select(F.round("w", 1).alias("width"), style.is_a4(F.col("w"), F.col("h")).alias("a4"), style.font_size_name(F.col("p")).alias("size_name"))


@query(f"SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, {_TOTAL} >= 0.3::DOUBLE AS verdict, count(*) AS n FROM ({sql.facts('documents', 'text', LATIN, 'doc_id')}) JOIN labels USING (doc_id) GROUP BY 1, 2, 3")
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score.scored(features.facts(table(spark, sf_dir, "documents"), "text", LATIN)).select("doc_id", (F.col("total_score") >= 0.3).alias("verdict"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"), "verdict").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 0 THEN 'empty file' WHEN octet_length(encode(text)) > 6144 THEN 'file too large' END AS problem, hex(encode(text)[1:16]) AS head FROM documents")
def read_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", files.read_problem(F.octet_length(c), 6144).alias("problem"), F.hex(files.head(c, 16)).alias("head"))


@query("SELECT n, CASE WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS label FROM (SELECT DISTINCT n_chars * n_chars AS n FROM documents)")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("n_chars") * F.col("n_chars")).alias("n")).distinct()
    return d.select("n", tx.size_text(F.col("n")).alias("label"))


@query("SELECT doc_id, octet_length(encode(text)) >= 2048 AND octet_length(encode(text)) <= 4096 AS fits FROM documents")
def policy_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", policy.size_filter(F.octet_length("text"), F.lit(2), F.lit(4)).alias("fits"))


@query("SELECT md5(text) AS rule_content, 1000 + row_number() OVER (ORDER BY item_id) AS rule_id FROM benchmark")
def rules_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("content"))
    return hashing.rules_of(b, "content", "item_id").select("rule_content", "rule_id")


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1")
def most_common_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "documents"), ["lang"], "source")


@query("SELECT severity, code, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) < 50 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN octet_length(encode(text)) < 50 THEN 2001 ELSE 2002 END::BIGINT AS code FROM documents WHERE octet_length(encode(text)) < 257) GROUP BY severity, code")
def error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    d = table(spark, sf_dir, "documents").where(n < 257).select(F.when(n < 50, "error").otherwise("warning").alias("severity"), F.when(n < 50, 2001).otherwise(2002).cast("bigint").alias("code"))
    return reports.error_counts(d, "severity", "code")


@query("SELECT source, array_to_string(list_sort(list(doc_id))[1:128], ',') AS ids FROM documents GROUP BY source")
def capped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return alerts.capped(table(spark, sf_dir, "documents"), ["source"], "doc_id").select("source", ids.alias("ids"))


@query(f"SELECT doc_id, len(list_filter([{', '.join(map(sql.q, style.RED_HEADER_WORDS))}], lambda w: contains(text, w))) > 0 AS header, len(list_filter([{', '.join(map(sql.q, style.SEAL_WORDS))}], lambda w: contains(text, w))) > 0 AS seal FROM {golden_sql(OFFICIALS)}")
def image_text_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(spark, OFFICIALS).select("doc_id", style.red_header_hint(F.col("text")).alias("header"), style.seal_hint(F.col("text")).alias("seal"))


_REASONS_SQL = """CASE WHEN total >= 0.6::DOUBLE THEN list_filter(['综合得分超过阈值，判定为公文', CASE WHEN copy_number <> '' THEN '包含份号: ' || copy_number END, CASE WHEN doc_number <> '' THEN '包含标准发文字号格式' END,
 CASE WHEN title <> '' AND title_type <> '' THEN '包含公文标题格式(' || title_type || ')' END, CASE WHEN len(org) > 0 THEN '包含党政机关名称' END], lambda x: x IS NOT NULL)
 ELSE list_filter(['综合得分未达到阈值，判定为非公文', CASE WHEN doc_number = '' THEN '缺少发文字号' END, CASE WHEN title = '' THEN '缺少公文标题格式' END, CASE WHEN issue_date = '' THEN '缺少成文日期' END, '未检测到红色版式元素',
 CASE WHEN len(prohibited) > 0 THEN '包含非公文特征内容' END], lambda x: x IS NOT NULL) END"""


@query(f"SELECT doc_id, array_to_string({_REASONS_SQL}, ';') AS reasons FROM (SELECT *, {_TOTAL} AS total FROM ({sql.facts(golden_sql(OFFICIALS), 'text', OFFICIAL, 'doc_id')}))")
def verdict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = score.scored(features.facts(golden(spark, OFFICIALS), "text", OFFICIAL))
    return d.select("doc_id", F.array_join(score.reasons(), ";").alias("reasons"))


_DESC_SQL = "'公文版式检测命中 (' || array_to_string(list_filter([CASE WHEN title_type <> '' THEN '文种: ' || title_type END, CASE WHEN len(org) > 0 THEN '发文机关: ' || array_to_string(org, '、') END, '置信度: ' || printf('%.1f%%', total * 100)], lambda x: x IS NOT NULL), '; ') || ')'"


@query(f"SELECT doc_id, {_DESC_SQL} AS rule_desc, array_to_string(list_filter([doc_number, title, issue_date], lambda x: x <> ''), ' | ') AS matched FROM (SELECT *, {_TOTAL} AS total FROM ({sql.facts(golden_sql(OFFICIALS), 'text', OFFICIAL, 'doc_id')})) WHERE total >= 0.6::DOUBLE")
def layout_alert_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = once(score.scored(features.facts(golden(spark, OFFICIALS), "text", OFFICIAL)), {"hit": alerts.layout_hit()})
    return d.where("hit is not null").select("doc_id", "hit.rule_desc", "hit.matched")


@query("SELECT event_type, count(*) FILTER (user_id % 2000 < 1024) AS inbound, count(*) FILTER (user_id % 2000 >= 1024) AS outbound FROM events GROUP BY event_type")
def connection_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    way = net.direction(F.col("user_id") % 2000)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(reports.count_if(way == "inbound").alias("inbound"), reports.count_if(way == "outbound").alias("outbound"))


@query("SELECT event_type, time_bucket(INTERVAL '10 minutes', ts)::VARCHAR AS start, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = streams.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return e.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# Events as records of all stores, pushed in three parts of the day with a flush before the last.
_STORE_OF = {"click": "alerts", "view": "audit_logs", "signup": "security_reports", "purchase": "command_results", "error": "alert_logs"}
_STORE_SQL = f"CASE {' '.join(f'WHEN event_type = {sql.q(k)} THEN {sql.q(n)}' for k, n in _STORE_OF.items())} ELSE 'policy_results' END"
_LIMIT_SQL = f"CASE {' '.join(f'WHEN store = {sql.q(n)} THEN {k}' for n, k in stores.LIMITS.items())} END"


@query(f"""WITH e AS (SELECT event_id, ts, value, {_STORE_SQL} AS store, CASE WHEN hour(ts) < 8 THEN 1 WHEN hour(ts) < 16 THEN 2 ELSE 3 END AS push FROM events),
 s AS (SELECT *, push = 3 AS now, row_number() OVER (PARTITION BY store, push = 3 ORDER BY push, ts NULLS FIRST, event_id NULLS FIRST) <= {_LIMIT_SQL} AS first FROM e)
 SELECT event_id, store, value, now AND first AS front, row_number() OVER (PARTITION BY store ORDER BY NOT (now AND first), now, first, push, ts NULLS FIRST, event_id NULLS FIRST) AS place FROM s""")
def store_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as popped from their stores: the front first, then spilled ones as they went down, with their place."""
    store = F.lit("policy_results")
    for kind, name in _STORE_OF.items():
        store = F.when(F.col("event_type") == kind, name).otherwise(store)
    part = F.when(F.hour("ts") < 8, 1).when(F.hour("ts") < 16, 2).otherwise(3)
    records = table(spark, sf_dir, "events").select("event_id", "ts", "value", store.alias("store"), part.alias("part"))
    line = stores.Stores(spark, shared_dir(spark), b"0123456789abcdef")
    for n in (1, 2, 3):
        if n == 3:
            line.flush()
        line.push(records.where(F.col("part") == n), "store", ["ts", "event_id"])
    records = written(line.pop("event_id bigint, value double").records)  # decrypted once, not again for the sort's sample
    rows = numbered(records, ["store", "line"], "n")
    start = rows.groupBy("store").agg((F.min("n") - 1).alias("before"))
    return rows.join(F.broadcast(start), "store").select("record.event_id", "store", "record.value", "front", (F.col("n") - F.col("before")).alias("place"))


@query(f"""SELECT doc_id, 1::BIGINT AS event_type, '通信 IP 异常' AS event_sub_type, 3::BIGINT AS risk, 'Detected unauthorized communication with ' || remote_ip AS msg FROM {_BAD}
 UNION ALL SELECT doc_id, 1, '签名异常', 4, left(coalesce(text, ''), 128) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events of connections that no whitelist holds, and of documents marked bad as if their signature were."""
    at = F.lit("2024-01-01 00:00:00")
    net_rows = _violations(spark, sf_dir).select("doc_id", reports.network_event(at, F.col("remote_ip"), F.lit("")).alias("e"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    signed = table(spark, sf_dir, "documents").join(bad, "doc_id").select("doc_id", reports.signature_event(at, F.col("text")).alias("e"))
    e = net_rows.unionByName(signed)
    return e.select("doc_id", *[F.col(f"e.{n}").cast("bigint").alias(n) for n in ("event_type", "risk")], "e.event_sub_type", "e.msg")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of documents to alert records: PDF files by type, pages and marker, texts by all detectors in order."""
    return _pdf_alerts(spark, sf_dir).drop("doc_id").unionByName(_alerts(spark, sf_dir))
