import pytest
from docsift.operators import failures
from pyspark.sql import functions as F


def test_only_recoverable_rows_are_tried_again(spark):
    seen = []

    def process(rows, attempt):
        seen.append(sorted(r.k for r in rows.collect()))
        assert rows.columns == ["k", "until", "code_"]
        return rows.withColumn("code", F.when(F.col("until") >= attempt, F.col("code_"))).withColumn("fatal", F.col("k") == "fatal")

    rows = [("good", 0, None), ("good", 0, None), ("late", 1, 1002), ("tool", 2, 3006), ("never", 9, 3001), ("format", 9, 2005), ("fatal", 9, 1002)]
    df = spark.createDataFrame(rows, "k string, until int, code_ int")
    got = sorted((r.k, r.code, r.recoverable, r.attempt) for r in failures.attempted(df, process).collect())
    assert got == [
        ("fatal", 1002, False, 1), ("format", 2005, False, 1), ("good", None, False, 1), ("good", None, False, 1), ("late", None, False, 2),
        ("never", 3001, True, 3), ("tool", None, False, 3),
    ]
    assert seen == [["fatal", "format", "good", "good", "late", "never", "tool"], ["late", "never", "tool"], ["never", "tool"]]


def test_empty_rows_one_attempt_and_none(spark):
    fail = lambda rows, attempt: rows.withColumn("code", F.lit(1002))
    df = spark.createDataFrame([(1,)], "k int")
    assert failures.attempted(df.where("false"), fail).count() == 0
    assert [(r.code, r.recoverable, r.attempt) for r in failures.attempted(df, fail, 1).collect()] == [(1002, True, 1)]
    with pytest.raises(ValueError):
        failures.attempted(df, fail, 0)


def test_codes(spark):
    codes = spark.createDataFrame([(c,) for c in (*failures.CODES.values(), None, 7)], "code int")
    may = {r.code for r in codes.where(failures.recoverable(F.col("code"))).collect()}
    assert may == {1002, 3001, 3006, 3007} and len(set(failures.CODES.values())) == 29
