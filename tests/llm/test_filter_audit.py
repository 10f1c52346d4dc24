import itertools
import re

import pytest

import __spark_entry__
from docsift.llm import filter_audit

WORDS = " ".join(f"w{i}" for i in range(120))
#: doc_id, text, lang, and columns whose names clash with the operator's own
DOCS = [
    (1, WORDS, "en", 7, "x"), (2, WORDS, "de", 7, "x"), (2, WORDS, "de", 7, "x"), (3, None, "en", 7, "x"), (4, "", None, 7, "x"),
    (5, "SHOUT " * 150, "", 7, "x"), (6, "price $5 " + WORDS, None, 7, "x"), (None, WORDS, "en", 7, "x"), (None, None, None, None, None),
    (9, " a\x0bb\x85c " * 60 + "É" * 50, "en", 7, "x"), (10, "word " * 200_000, "fr", 7, "x"), (0, "few #words", "en", 7, "x"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (5, None, 1), (6, 1, None), (77, 1, 1), (None, 1, 1)]


def plain(docs, labels):
    def mask(i, text):
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        checks = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search("[#$%&*|]", t), e)
        return {x for x, c in zip("ABCDE", checks) if c}

    label = lambda i, k: i is not None and any(row[0] == i and row[k] == 1 for row in labels)
    rows = [(lang or "", mask(i, t), label(i, 1), label(i, 2)) for i, t, lang, *_ in docs]
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, before = [r for r in left if x in r[1]], left
                left = [r for r in left if x not in r[1]]
                late = sum(x in r[1] for r in own) - sum(x in r[1] for r in before)
                out[part, order, step] = (len(left), len(gone), late, sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, digest string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def found(df):
    rows = df.collect()
    assert df.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    out = {(r[0], r[1], r[2]): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_equals_brute_force(spark, tmp_path):
    got = found(filter_audit.op11_filter_audit(spark, tables(spark, tmp_path, DOCS, LABELS)))
    assert got == plain(DOCS, LABELS) and len(got) == 4 * 600


def test_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {tuple(r[:3]): tuple(r[3:]) for r in con.execute(__spark_entry__.oracle_sql()["op11_filter_audit"]).fetchall()}
    assert found(filter_audit.op11_filter_audit(spark, sf)) == want


def test_empty_tables(spark, tmp_path):
    assert filter_audit.op11_filter_audit(spark, tables(spark, tmp_path, [], [])).collect() == []


def test_one_frequent_text_and_no_labels(spark, tmp_path):
    docs = [(i, "same text", "en", 0, "") for i in range(500)] + [(1000, WORDS, "en", 0, "")]
    got = found(filter_audit.op11_filter_audit(spark, tables(spark, tmp_path, docs, [])))
    assert got["en", "EABCD", 1][:2] == (2, 499) and got["en", "AEBCD", 2][1:4] == (0, 499, 0)


def test_number_of_filters_is_bounded(spark):
    rows = spark.createDataFrame([("p", 1, True, False)], "part string, mask int, good boolean, toxic boolean")
    assert filter_audit.replay(rows, "AB").count() == 4
    for bad in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            filter_audit.replay(rows, bad)
