import hashlib
import random
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docsift.llm import multiset_hash as mh

SCHEMA = "doc_id long, text string, key string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) + rng.choice(["", "", ".\n"]) for _ in range(n))


def test_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i * 3 - 20, prose(rng, rng.choice([0, 1, 3, 50, 400]))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "é😀" * 4000), (None, "no id here"), (7000, rows[5][1]), (7001, rows[5][1])]
    rows += [rows[8]] * 2
    got = mh.edited_fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    text = {i: t or "" for i, t in rows}
    by_text = {}
    for r in got:
        by_text.setdefault("\n".join(sorted(text[r.doc_id].split("\n"))), set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if hashlib.sha256(text[r.doc_id].encode()).hexdigest() == r.edited_sha256:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
        else:
            assert r.fingerprint != r.edited_fingerprint
    assert all(len(f) == 1 for f in by_text.values()) and len({f for s in by_text.values() for f in s}) == len(by_text)
    long = [r for r in got if r.n_chars > 500 and " " in text[r.doc_id]]
    assert sum(r.near_edited for r in long) / len(long) > 0.5 > 0.3 > sum(r.near_next for r in long if r.near_next < 1) / len(long)


def test_insert_and_delete(spark):
    df = frame(spark, [(1, "a b\nc d e\nf"), (2, "f\na b"), (3, "c d e"), (4, "c d e\nf\na b"), (5, "x\nx"), (6, "x")])
    v = {r.doc_id: r.v for r in mh.vectors(df).collect()}
    assert v[1] == v[4] and v[5] != v[6]
    pair = spark.createDataFrame([(v[1], v[3], v[2])], "x array<long>, y array<long>, z array<long>")
    r = pair.select(mh.added(F.col("x"), F.col("y"), -1).alias("less"), mh.added(F.col("z"), F.col("y")).alias("more")).first()
    assert r.less == v[2] and r.more == v[1]


def test_empty_and_single(spark):
    assert mh.edited_fingerprints(frame(spark, [])).count() == 0
    r = mh.edited_fingerprints(frame(spark, [(9, "abcdefghi")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and r.near_next == 1


def plain_vector(text):
    """The vector as the module's docstring states it, in plain Python."""
    exact, counters, n = [0] * 8, [0] * 128, 0
    ranges = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
    for p in text.split("\n"):
        digest = hashlib.sha256(p.encode()).digest()
        exact = [(e + int.from_bytes(digest[4 * k : 4 * k + 4], "big")) % 2**32 for k, e in enumerate(exact)]
        p = re.sub(f"([{ranges}])", r" \1 ", p)
        found = list(re.finditer(rf"\S{{1,{mh.RUN}}}", p))
        for a, b in zip(found, found[1:] + [None]):
            u = xxhash.xxh64_intdigest(p[a.start() : b.end() if b else a.end()].encode(), 42)
            salted = int.from_bytes(struct.pack("<Q", u), "little")
            seed = xxhash_int(1, 42)
            for h, bits in enumerate((u, xxhash_long(salted, seed))):
                for j in range(32):
                    counters[64 * h + 2 * j] += bits >> j & 1
                    counters[64 * h + 2 * j + 1] += bits >> (j + 32) & 1
            n += 1
    words = [counters[2 * i] + (counters[2 * i + 1] << 32) for i in range(64)]
    return exact + words + [n]


def xxhash_int(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<i", value), seed)


def xxhash_long(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<Q", value), seed)


def plain_likeness(x, y):
    sign = lambda v: np.array([2 * (w >> s & 0xFFFFFFFF) - v[-1] for w in v[8:-1] for s in (0, 32)], float)
    a, b = sign(x), sign(y)
    both = a @ a + b @ b
    return 1.0 if x == y else 0.0 if not both else max(0.0, 1 - (a - b) @ (a - b) / both)


def test_fingerprints_and_likeness_against_plain_python(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 40, 200])).replace(". ", "\n")) for i in range(25)]
    rows += [(100, "漢字とかな交じり文です。" * 20), (101, "漢字とかな交じり文です。" * 20 + "。"), (102, "\n\n a\tb \n"), (103, "x" * 100), (104, None)]
    got = {r.doc_id: r for r in mh.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    as_hex = lambda v: "".join(f"{w:016x}" for w in v)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        v, e, a = plain_vector(t), plain_vector(t[: len(t) - k] + after[:k]), plain_vector(after)
        r = got[i]
        assert r.fingerprint == as_hex(v) and r.edited_fingerprint == as_hex(e)
        assert abs(r.near_edited - plain_likeness(v, e)) < 1e-9 and abs(r.near_next - plain_likeness(v, a)) < 1e-9
    assert got[101].near_next > 0.95


def test_near_copies_stay_near_and_long_texts_hold(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    early = ["new", *base]
    rows = [(4, " ".join(early)), (3, " ".join(base)), (2, "y z " * 600_000), (1, "y z " * 600_000 + "end")]
    got = {r.doc_id: r for r in mh.edited_fingerprints(frame(spark, rows)).collect()}
    assert got[4].near_next > 0.97 and got[3].near_next < 0.3 and got[2].near_next > 0.999 and got[2].near_edited > 0.999
