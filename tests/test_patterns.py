import base64
import random

import numpy as np
import pytest
from docsift.operators import hashing, keywords, patterns
from pyspark.sql import functions as F


def test_keys_of_a_pattern_are_among_the_texts(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(patterns, "BLOCK", 500)
    for n in (1, 2, 3, 7, 8, 9, 31, 32, 50, 127, 128, 129, 400):
        tier = next((t for t in patterns.TIERS if n >= t), n)
        for _ in range(20):
            pattern = bytes(rng.choice(b"abcd") for _ in range(n))
            text = rng.randbytes(rng.randrange(1200)) + pattern + rng.randbytes(rng.randrange(700))
            of_text, of_pattern = patterns.keys(text, tier), patterns.keys(pattern, tier)
            assert len(of_pattern) and np.isin(of_pattern, of_text).all()
    assert not len(patterns.keys(b"short", 8))
    sparse = patterns.keys(rng.randbytes(100_000), 128)
    assert len(sparse) < 100_000 * 2.5 / 65


@pytest.mark.parametrize("few", [patterns.FEW, 0])
def test_pairs_equal_brute_force(spark, monkeypatch, few):
    """With the patterns' keys at the tasks, and with all keys in the join."""
    monkeypatch.setattr(patterns, "FEW", few)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab ") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 33, 130]))) for _ in range(150)]
    common = bytes(rng.choice(b"xyz") for _ in range(300))
    words += [common + b"%d" % i for i in range(60)] + [b"", b"zz"]
    texts = [rng.randbytes(5) + b"".join(rng.choice(words) for _ in range(6)) for _ in range(120)] + [b"", None, common, common + b"7"]
    rows = [(i, None if t is None else bytearray(t)) for i, t in enumerate(texts)] + [(3, bytearray(texts[3]))]
    d = spark.createDataFrame(rows, "id int, c binary")
    p = spark.createDataFrame([(bytearray(w),) for w in words] + [(None,)], "p binary")
    got = sorted((r.id, bytes(r._pattern)) for r in patterns.contained(d, "c", p, "p").select("id", "_pattern").collect())
    want = sorted((i, w) for i, t in rows if t for w in set(words) if w and w in bytes(t))
    assert got == want


def test_patterns_with_a_common_beginning_don_t_meet_at_one_key(spark):
    common = random.Random(3).randbytes(400)
    p = spark.createDataFrame([(bytearray(common + random.Random(i).randbytes(200)),) for i in range(300)], "p binary")
    most = patterns.pattern_keys(p, "p").groupBy("tier", "key").count().agg(F.max("count")).first()[0]
    assert most == 1


def test_first_rule_of_many(spark):
    """More rules than were once allowed; the least rule id of those that a file holds; repeated rows stay."""
    rules = spark.range(30_000).select(F.col("id").alias("rule_id"), F.concat(F.lit("r"), "id").alias("rule_desc"), F.base64(F.concat(F.lit("<"), F.sha2(F.col("id").cast("string"), 256), F.lit(">")).cast("binary")).alias("rule_content"))
    last = rules.where("rule_id = 29999").withColumn("rule_id", F.lit(50_000).cast("long"))
    held = {1: [29999], 2: [17, 4], 3: [], 4: [8]}
    sha = {i: __import__("hashlib").sha256(str(i).encode()).hexdigest() for i in (29999, 17, 4, 8)}
    files = [(k, bytearray(("x" * 50).join(f"<{sha[i]}>" for i in v).encode() + b"tail")) for k, v in held.items()] + [(4, bytearray(f"<{sha[8]}>".encode() + b"tail")), (5, None), (6, bytearray(b""))]
    got = hashing.byte_pattern_hits(spark.createDataFrame(files, "k int, content binary"), rules.unionByName(last), ["k"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, 29999, "r29999"), (2, 4, "r4"), (4, 8, "r8"), (4, 8, "r8")]
    assert base64.b64decode(rules.first().rule_content).startswith(b"<")


def test_features_of_any_number(spark):
    rules = [(i, f"word{i}, Other{i} ", "", i) for i in range(12_000)] + [(90_000, "word5", "late", 90_000), (3, "é,@", "", 3)]
    d = spark.createDataFrame([(1, "a WORD5 b other11999 É"), (1, "a WORD5 b other11999 É"), (2, None), (3, ""), (4, "x@y")], "id int, t string")
    got = sorted((r.id, r.feature, r.rule_id) for r in keywords.feature_hits(d, F.col("t"), spark.createDataFrame(rules, "rule_id int, rule_content string, rule_desc string, ord int"), ["id"]).collect())
    one = [(1, "other1", 1), (1, "other11", 11), (1, "other119", 119), (1, "other1199", 1199), (1, "other11999", 11999), (1, "word5", 90_000), (1, "é", 3)]
    assert got == sorted(one * 2 + [(4, "@", 3)])
