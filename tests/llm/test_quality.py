import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import quality

SCHEMA = "doc_id long, text string, score string, y int"
LABELS = "doc_id long, quality int, toxic int"


def texts(rng, n):
    vocab = ["river", "stone", "walks", "under", "gentle", "morning", "letters", "build", "house"]
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(20, 200))]
        yield i, i % 4 != 0, " ".join(w).capitalize() + "." if i % 4 else " ".join(x.upper() + "!!" for x in w)


def test_held_out_accuracy_and_contract(spark):
    rng = random.Random(2)
    rows = list(texts(rng, 900))
    docs = [(i, t, "x", 0) for i, _, t in rows] + [(1000, None, "x", 1), (1001, "", None, 1), (1002, ". ".join(t for _, y, t in texts(rng, 900) if y), "", 0), (None, "stone", "", 0), (5, rows[5][2], "", 0)]
    labels = [(i, int(y), 0) for i, y, _ in rows if i % 3] + [(1000, 1, 0), (None, 0, 0), (7, None, 1), (99999, 1, 0)]
    got = quality.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    want = {i: y for i, y, _ in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97
    assert next(r for r in got if r.doc_id == 1002).predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", 0), (2, None, "", 0)], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert all(r.score > 0.9 for r in quality.classify(docs, one).collect())
    assert quality.classify(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_tiny_sample_falls_back_to_raw_dictionaries(spark):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "BAD!! ***", "", 0) for i in range(12)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], LABELS)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert got[1] > got[0]


@pytest.mark.parametrize("sf,good,bad", [("sf0.001", 0.95, 0.6), ("sf0.01", 0.95, 0.85), ("sf0.1", 0.99, 0.95)])
def test_held_out_documents_of_the_given_tables(spark, sf, good, bad):
    at = f"/root/testdata/{sf}"
    got = quality.op5_quality_classifier(spark, at).where("held_out")
    both = got.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    part = {r.quality: r.p for r in both.where("quality is not null").groupBy("quality").agg(F.avg("predicted").alias("p")).collect()}
    assert part[1] >= good and 1 - part[0] >= bad


def test_weights_are_never_negative():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = np.column_stack((rng.normal(y, 1.0), rng.normal(-2.0 * y, 1.0)))
    weights, _ = quality.calibrated(x, y, np.ones(400))
    assert weights[0] > 0 and weights[1] == 0


def test_whole_text_counts_and_repeats_stay(spark):
    rng = random.Random(3)
    rows = [(i, t, "", 0) for i, _, t in texts(rng, 600)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(600)]
    bad = " ".join(t for i, t, *_ in rows if i % 4 == 0)
    late = rows[1][1] + " " + bad * 3  # good only in its first words
    docs = spark.createDataFrame([*rows, (700, late, "", 0), (700, late, "", 0), (701, "", "", 0), (702, None, "", 0)], SCHEMA)
    got = quality.classify(docs, spark.createDataFrame(labels, LABELS)).where("doc_id >= 700").collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 4 and score[700] < 0.3 and score[701] == score[702]
