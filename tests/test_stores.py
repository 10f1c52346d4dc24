import random

import pytest
from docsift.sources import stores
from pyspark.sql import functions as F

KEY = b"k" * 16


class Plain:
    """The same in lists: a front up to a limit, spilled records behind it."""

    def __init__(self, limits):
        self.limits, self.front, self.spilled = limits, {n: [] for n in limits}, {n: [] for n in limits}

    def push(self, rows):
        for store, k in rows:
            (self.front if len(self.front[store]) < self.limits[store] else self.spilled)[store].append(k)

    def flush(self):
        for n in self.limits:
            self.spilled[n] += self.front[n]
            self.front[n] = []

    def pop(self):
        got = {n: (self.front[n], self.spilled[n]) for n in self.limits if self.front[n] or self.spilled[n]}
        self.__init__(self.limits)
        return got


def popped(out):
    got = {}
    for r in out.records.orderBy("store", "line").collect():
        got.setdefault(r.store, ([], []))[0 if r.front else 1].append(r.record.k)
    return got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_run_of_pushes_flushes_and_pops(spark, tmp_path, seed):
    rng, limits, k = random.Random(seed), {"a": 3, "b": 7, "c": 0}, 0
    real, plain = stores.Stores(spark, str(tmp_path / "s"), KEY, limits), Plain(limits)
    for step in ("push", "push", "flush", "push", "pop", "push", "flush", "flush", "push", "push", "pop", "pop"):
        if step == "push":
            rows = [(rng.choice("aaaabc"), k + i) for i in range(rng.randrange(0, 14))]
            k += 14
            plain.push(rows)
            real.push(spark.createDataFrame(rng.sample(rows, len(rows)), "store string, k int").repartition(3), "store", ["k"])
        elif step == "flush":
            plain.flush()
            real.flush()
        else:
            out = real.pop("store string, k int")
            assert popped(out) == plain.pop()
            real.clear(out)


def test_a_push_that_fails_leaves_nothing(spark, tmp_path):
    s = stores.Stores(spark, str(tmp_path / "s"), KEY)
    rows = spark.range(300).select(F.lit("alerts").alias("kind"), F.col("id").cast("int").alias("k"))
    s.push(rows, "kind", ["k"])
    broken = rows.withColumn("k", F.when(F.col("k") == 250, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("k")))
    for bad in (broken, rows.withColumn("kind", F.lit("no store")), rows.withColumn("kind", F.lit(None).cast("string"))):
        with pytest.raises(Exception):
            s.push(bad, "kind", ["k"])
    assert len(list((tmp_path / "s").iterdir())) == 1
    (tmp_path / "s" / "p000000000009-cut").mkdir()  # a driver that went away: never committed
    s.push(rows.limit(1), "kind", ["k"])
    out = s.pop("kind string, k int")
    front, spilled = popped(out)["alerts"]
    assert front == list(range(100)) and spilled == [*range(100, 300), 0]


def test_what_comes_after_a_pop_stays(spark, tmp_path):
    s = stores.Stores(spark, str(tmp_path / "s"), KEY)
    one = lambda k: spark.createDataFrame([("policy_results", k, None, k), ("policy_results", k, None, k)], "line string, store int, record string, k int")
    schema = "line string, store int, record string, k int"
    assert popped(s.pop(schema)) == {}
    s.push(one(1), "line", ["k"])
    out = s.pop(schema)
    s.push(one(2), "line", ["k"])
    assert popped(out) == {"policy_results": ([1, 1], [])} and out.records.first().record.record is None
    s.clear(out)
    assert popped(s.pop(schema)) == {"policy_results": ([2, 2], [])}
    assert popped(stores.Stores(spark, str(tmp_path / "s"), b"j" * 16).pop(schema)) == {}
    s.push(one(3).where("false"), "line", ["k"])
    assert popped(s.pop(schema)) == {"policy_results": ([2, 2], [])}


def test_arguments(spark, tmp_path):
    for wrong in ({"key": b"short"}, {"key": KEY, "limits": {"a": -1}}):
        with pytest.raises(ValueError):
            stores.Stores(spark, str(tmp_path), **wrong)


def test_records_move_for_their_order_alone(spark):
    from docsift.plans import queries

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")  # as if tables were large
        out = queries.store_lines(spark, "/root/testdata/sf0.001")
        assert out.count() == 1000
        plans = [out, stores.Stores(spark, "/nowhere", KEY)._fronts(spark.createDataFrame([("alerts", 1, 0, 1, b"")], stores.ROW))]
        assert not [p for p in plans if "SortMergeJoin" in p._jdf.queryExecution().executedPlan().toString()]
    finally:
        spark.conf.set(key, before)
