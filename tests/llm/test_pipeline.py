import os
import random
from collections import Counter

import corpus_pipeline as cp
import pytest
from docsift.llm import common, simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, mixture string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    letters = {"en": "thonrewh", "fr": "éèçoiuxq"}
    rows, labels = [], []
    for i in range(300):
        lang = rng.choice(["en", "fr"])
        w = ["".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(30, 120))]
        good = i % 6 != 0
        t = " ".join(w).capitalize() + "." if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, t, lang, f"s{i % 3}", len(t), 1, "m"))
        if i % 2:
            labels.append((i, int(good), 0))
    for i in range(0, 300, 6):
        labels.append((i, 0, 0))
    rows += [(300 + k, rows[7][1], "en", "s0", 1, 1, "m") for k in range(5)] + [rows[8], rows[8]]
    rows += [(400, None, None, None, None, None, None), (401, "", "en", None, 0, 1, "m"), (402, "1 2 3 . . .", "en", "s1", 5, 1, "m"), (None, rows[10][1] + " new", "en", "s2", 9, 1, "m")]
    path = common.shared_dir(spark)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_keep_clean_documents_and_columns(spark, tables):
    docs = first = common.table(spark, tables, "documents")
    sizes = []
    for name, stage in cp.STAGES[:-1]:
        docs = common.written(stage(spark, docs, tables))
        assert docs.schema.names == first.schema.names
        sizes.append((name, Counter(r.doc_id for r in docs.select("doc_id").collect())))
    quality, language, dedup, mixed = (c for _, c in sizes)
    clean = [i for i in range(300) if i % 6]
    assert sum(i in quality for i in clean) >= 0.98 * len(clean) and sum(i in quality for i in range(0, 300, 6)) <= 3
    assert sum(i in language for i in clean) >= 0.98 * len(clean) and not {400, 401, 402} & set(language)
    assert sum(dedup[i] for i in (7, 300, 301, 302, 303, 304)) == 1 and dedup[8] == 1
    assert sum(i in dedup for i in clean) >= 0.98 * len(clean)
    assert set(mixed) <= set(dedup) and max(mixed.values()) <= 3
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
    total = sum(words.values())
    for s, share in (("s0", 1), ("s1", 2), ("s2", 3)):
        assert abs(words[s] / total - share / 6) < 0.03
    pieces = cp.STAGES[-1][1](spark, docs, tables).collect()
    assert sum(r.length for r in pieces) > 0 and {r.doc_id for r in pieces} == set(mixed)


def test_run_and_empty_table(spark, tables):
    assert cp.run(spark, tables).count() > 100
    empty = common.table(spark, tables, "documents").where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, tables).count() == 0


def test_near_copies_of_similarity_above_limit_go(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near, far = [], [], []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(400)]
        rows.append((2 * i, " ".join(w), "en", "s", 1, 1, "m"))
        other = list(w)
        for at in rng.sample(range(5, 395), (5, 8, 12, 20)[i % 4]):
            other[at] = "changed"
        a, b = grams(w), grams(other)
        (near if len(a & b) / len(a | b) >= 0.8 else far).append(2 * i + 1)
        rows.append((2 * i + 1, " ".join(other), "en", "s", 1, 1, "m"))
    base = [rng.choice(vocabulary) for _ in range(400)]
    for k in range(200):  # one large group
        w = list(base)
        w[5 + k] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "s", 1, 1, "m"))
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = {r.doc_id for r in cp.one_of_near_duplicates(spark, docs, "").collect()}
    assert len(near) > 60 and len(far) > 30
    assert sum(i in got for i in near) <= 0.05 * len(near)
    assert all(i in got for i in far) and all(2 * i in got for i in range(150))
    assert sum(i >= 1000 for i in got) == 1


def test_crowd_around_the_limit_against_all_pairs(spark):
    """Texts near one base, most pairs just below the limit: links are those of all pairs but for a few at the very limit."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(2, 12)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(w)
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    low = 0
    for i in range(300):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both >= 0.8 * (len(grams[i]) + len(grams[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
            else:
                low += 1
    want = {i for i in range(300) if find(i) == i}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id for r in simhash.first_of_similar(docs).collect()}
    assert low > 20_000 and len(want) > 20
    assert want <= got and len(got - want) <= 0.05 * 300


def test_languages_mixed_stay_and_unlearnt_text_goes(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choice(s) for _ in range(5)) for _ in range(60)] for k, s in {"aa": "thonrewhs", "bb": "léoiuxqamp", "cc": "ßäüdlkztei"}.items()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, prose(lang, 80), lang) for i in range(300) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(1000 + i, " ".join(prose(k, 40) for k in ("aa", "bb", "cc")), "aa") for i in range(20)]
    random_of = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(80))
    rows += [(2000 + i, random_of("абвгдежзиклмнопрст"), None) for i in range(20)]
    rows += [(3000 + i, random_of("abcdefghijklmnopqrstuvwxyz"), None) for i in range(20)]
    got = {r.doc_id for r in cp.known_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()}
    assert sum(i < 300 for i in got) == 300 and sum(1000 <= i < 2000 for i in got) == 20
    assert not [i for i in got if i >= 2000]


def test_numbers_hold_when_a_scan_is_planned_anew(spark):
    docs = common.written(spark.range(20_000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text").repartition(3))
    rows = cp._numbered(docs)
    numbers = lambda: {r.doc_id: r[cp.ROW] for r in rows.select("doc_id", cp.ROW).collect()}
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        spark.conf.set(size, "64m")
        first = numbers()
        spark.conf.set(size, "100k")
        rows = rows.where("true")
        assert numbers() == first
    finally:
        spark.conf.set(size, before)


def test_language_stage_decides_by_the_mixture(spark, tables, monkeypatch):
    from docsift.llm import langid

    docs = common.table(spark, tables, "documents")
    model, texts = langid.fit(docs), [r.text for r in docs.where("doc_id in (1, 2, 3, 4, 5, 7)").collect()]
    both = " ".join(texts)
    alone, mixed = model.surplus(both, ["en"]), model.surplus(both, [k for k, _ in model.mixtures([both])[0][2]])
    assert alone < mixed and mixed >= 0 and model.surplus("1 2", []) is None
    asked, chosen = [], langid.predicted
    monkeypatch.setattr(langid, "predicted", lambda *a, **b: (asked.append(1), chosen(*a, **b))[1])
    assert cp.known_language(spark, docs, tables).count() > 250 and asked


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return [f for d in dirs for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = set(_shuffle_files(spark))
    t = common.written(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n")))
    assert t.count() == 7_000 and t.agg(F.sum("n")).first()[0] == 50_000
    t = common.written(spark.range(50_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n")))
    left = {f for f in set(_shuffle_files(spark)) - before if f.endswith(".data")}
    assert len(left) <= 1  # of the count


def test_dedup_and_mixing_neither_copy_nor_move_texts(spark, tables, monkeypatch):
    docs, stored, put = common.table(spark, tables, "documents"), [], common.written
    monkeypatch.setattr(common, "written", lambda df, *a: (stored.append(df.columns), put(df, *a))[1])
    for stage in (cp.one_of_near_duplicates, cp.mixed_sources):
        out = stage(spark, docs, tables)
        assert out.count() > 200 and out.schema.names == docs.schema.names
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(_docsift_row" not in plan
    assert stored and not [c for c in stored if "text" in c]


def test_chosen_rows_come_as_often_as_marked(spark):
    ids = [-130, -64, -1, 0, 1, 63, 64, 127, 5 << 40, (5 << 40) + 63]
    rows = spark.createDataFrame([(i, str(i)) for i in ids + [2, 65, 6 << 40]], "id long, text string")
    once = common.chosen(rows, "id", common.marks(spark.createDataFrame([(i,) for i in ids + ids[:3]], "id long"), "id"))
    assert sorted(r.id for r in once.collect()) == ids and once.columns == rows.columns
    often = spark.createDataFrame([(i, t) for n, i in enumerate(ids) for t in range(n % 3)], "id long, time int")
    got = Counter(r.id for r in common.chosen(rows, "id", common.marks(often, "id", "time")).collect())
    assert got == Counter({i: n % 3 for n, i in enumerate(ids) if n % 3})


def test_tables_some_at_a_time_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(120)]
        for k in range(4):
            w = list(base)
            for at in rng.sample(range(120), 2 * k):
                w[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * i + k, " ".join(w)))
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string"))
    kept, asked, post = [], [], simhash._wide_postings
    monkeypatch.setattr(simhash, "_wide_postings", lambda n, bits, tables, some: (asked.append(len(some)), post(n, bits, tables, some))[1])
    for most in (7, 1000):
        monkeypatch.setattr(simhash, "AT_ONCE", most)
        asked.clear()
        kept.append(sorted(r.doc_id for r in simhash.first_of_similar(docs).collect()))
        assert max(asked) <= most and sum(asked) == 2 * simhash.tables_for(160)[1]
    assert kept[0] == kept[1] and 40 <= len(kept[0]) < 160


def _crowd(rng, first, n):
    """n texts near one base; most pairs are similar, but the least id to few."""
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(300), 5 if k == 0 else rng.randrange(2, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        yield first + k, " ".join(w)


def test_a_linked_group_is_not_paired_up(spark, monkeypatch):
    rng, pairs, put = random.Random(4), [], common.written
    docs = put(spark.createDataFrame(list(_crowd(rng, 0, 400)), "doc_id long, text string"))

    def stored(df, *a):
        out = put(df, *a)
        if out.columns == ["a", "b", "d"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(common, "written", stored)
    assert simhash.first_of_similar(docs).count() == 1
    assert pairs and sum(pairs) <= 400  # of 79,800


def test_texts_unlike_all_others_are_posted_once(spark, monkeypatch):
    rng, posted, post = random.Random(6), [], simhash._wide_postings
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(100))) for i in range(500)]
    docs = common.written(spark.createDataFrame(rows + list(_crowd(rng, 1000, 80)), "doc_id long, text string"))
    monkeypatch.setattr(simhash, "_wide_postings", lambda n, bits, tables, some: (posted.append((some.start, n.count())), post(n, bits, tables, some))[1])
    got = {r.doc_id for r in simhash.first_of_similar(docs).collect()}
    again = [n for at, n in posted if at == 0][1:]
    assert got == {*range(500), 1000} and again == [80]
