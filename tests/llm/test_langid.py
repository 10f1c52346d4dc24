import random
import zlib
from itertools import combinations

import numpy as np

from docsift.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, t int"
PARTS = {"aa": "thonrewh", "bb": "éèçoiuxq", "cc": "ßäüölkzt"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_held_out_accuracy_mixtures_and_contract(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, rng.randrange(3, 120)), lang, "x", 1) for i, lang in enumerate(rng.choices(list(PARTS), k=600))]
    mixed = prose(rng, "aa", 300) + "\n" + prose(rng, "cc", 150)
    odd = [(1000, None, "aa", "", 0), (1001, "", None, "", 0), (1002, "12 !? 。", None, "", 0), (1003, mixed, None, "", 0), (1004, prose(rng, "bb", 60000), None, "", 0), (None, "thon", None, "", 0), rows[0]]
    got = langid.identify(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(got) == len(rows) + len(odd)
    lang = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred in PARTS or r.lang_pred == "und")
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1004)] == ["und", "und", "und", "bb"]
    share = {m.language: m.proportion for m in by[1003].mixture}
    assert by[1003].lang_pred == "aa" and set(share) == {"aa", "cc"} and abs(share["aa"] - 2 / 3) < 0.1
    single = [r for r in held if len(rows[r.doc_id][1]) > 200]
    assert sum(len(r.mixture) == 1 for r in single) / len(single) > 0.9


def test_nothing_learnt(spark):
    df = spark.createDataFrame([(1, "some text", None, "", 0)], SCHEMA)
    assert langid.identify(df).first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def spoken(n, seed=5):
    """n made-up languages, each of its own words."""
    rng = random.Random(seed)
    return {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(60)] for k in range(n)}


def test_every_language_is_learnt_also_beyond_the_table(spark):
    rng, words = random.Random(1), spoken(langid.DENSE + 16)
    rows = [(i, " ".join(rng.choices(words[k], k=60)), k, "", 0) for i, k in enumerate(list(words) * 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    five = list(words)[3:78:15]
    model = langid.fit(df)
    mixed = " ".join(" ".join(rng.choices(words[k], k=120)) for k in five)
    [(_, _, share)] = model.mixtures([mixed])
    assert {k for k, _ in share} == set(five) and all(abs(p - 0.2) < 0.05 for _, p in share)


def test_table_and_found_counts_agree(spark):
    rng, words = random.Random(2), spoken(5)
    rows = [(i, " ".join(rng.choices(words[k], k=40)), k, "", 0) for i, k in enumerate(list(words) * 20)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    text = " ".join(r[1] for r in rows) * 3
    a, n = model.segments(text)
    model.table = None
    b, m = model.segments(text)
    assert n == m and a.shape == b.shape and np.abs(a - b).max() < 1e-3


def test_the_set_is_the_best_of_all_sets():
    rng = np.random.default_rng(4)
    size = np.array([30, 8, 60, 1, 25, 40])
    ll = rng.normal(-100, 2, (size.sum(), 4))
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    for d, langs in enumerate([(0,), (1, 2), (0, 1, 3), (2,), (0, 1, 2, 3), (3,)]):
        for i in range(size[d]):
            ll[starts[d] + i, langs[i % len(langs)]] += 12
    like = np.exp(ll - ll.max(axis=1, keepdims=True))
    means = np.add.reduceat(ll, starts, axis=0) / size[:, None]
    got = langid._chosen(like, size, means)
    for d, n in enumerate(size):
        part, cost = like[starts[d] : starts[d] + n], {}
        for k in range(1, 5):
            for chosen in combinations(range(4), k):
                allowed = np.zeros((1, 4), bool)
                allowed[0, list(chosen)] = True
                _, fit, _ = langid._em(part, np.array([n]), allowed)
                cost[chosen] = -2 * fit[0] + langid.PENALTY * np.log(n + 1) * (k - 1)
        assert tuple(np.flatnonzero(got[d])) == min(cost, key=cost.get)


def test_long_text_is_read_in_parts(monkeypatch):
    text = "Ünïcode text with several words. " * 50
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "_CHUNK", 240)
    assert np.array_equal(langid.trigrams(text), whole)


def test_a_result_is_of_the_text_alone(spark):
    """Alone, in any batch and any partitioning the scores are equal to the last bit."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = docs.where("text is not null").limit(80).collect()
    texts = [r.text for r in rows]
    texts += [a[:400] + b[:300] + c[:500] for a, b, c in zip(texts, texts[20:], texts[40:])]
    together = model.mixtures(texts)
    assert [model.mixtures([t])[0] for t in texts] == together
    assert model.mixtures(texts[::-1])[::-1] == together
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = lambda n: [tuple(r) for r in langid.predicted(df.repartition(n), model).select("doc_id", "lang_pred", "score").orderBy("doc_id").collect()]
    assert of(1) == of(7) == [(i, r[0], r[1]) for i, r in enumerate(together)]
