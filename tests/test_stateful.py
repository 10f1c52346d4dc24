import random
import time

from docsift.operators import policy
from docsift.streaming import monitor, stateful, streams
from pyspark.sql import functions as F


def fed(spark, at, batches, schema):
    """A stream that delivers each batch by itself, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        time.sleep(1.05)  # files are taken by their time of change
    return streams.table_feed(spark, at, spark.createDataFrame([], schema).schema.simpleString()[7:-1].replace(":", " "), 1)


def run(spark, stream, at):
    with stateful.rocksdb(spark):
        q = streams.run_to(stream, streams.to_table(f"{at}/out"), f"{at}/checkpoint")
        q.awaitTermination(200)
    return spark.read.parquet(f"{at}/out").drop("batch").collect()


def test_a_vanished_file_is_reported_until_it_is_back(spark, tmp_path):
    tick = lambda t: t * 60
    scans = {  # what each tick's scan finds
        1: [("same", "s"), ("gone", "g"), ("odd", "x")], 2: [("same", "s"), ("odd", "o"), ("new", "n")], 3: [("same", "s"), ("odd", None)],
        4: [("same", "s"), ("gone", "g"), ("odd", "o")], 5: [("same", "s"), ("odd", "o")], 6: [("same", "s"), ("gone", "changed"), ("odd", "o")],
    }
    schema = "path string, digest string, at timestamp"
    from datetime import datetime, timezone

    when = lambda t: datetime.fromtimestamp(tick(t), timezone.utc)
    feed = fed(spark, f"{tmp_path}/in", [[(p, d, when(t)) for p, d in rows] for t, rows in scans.items()], schema)
    base = spark.createDataFrame([("same", "s", when(0)), ("gone", "g", when(0)), ("odd", "o", when(0)), ("never", "z", when(0))], "path string, digest string, since timestamp")
    got = run(spark, stateful.integrity_watch(feed, base, 60_000).select("path", F.unix_seconds("at").alias("at"), "state"), tmp_path)
    want = [("gone", tick(t), "deleted") for t in (2, 3, 5)] + [("gone", tick(6), "modified"), ("new", tick(2), "added"), ("odd", tick(1), "modified"), ("odd", tick(3), "unreadable")]
    want += [("never", tick(t), "deleted") for t in range(1, 7)]
    assert sorted(map(tuple, got)) == sorted(want)


OPS = "module string, version long, cmd string, rule_id long, rule_content string"


def test_any_order_of_arrival_gives_the_batch_fold(spark, tmp_path):
    rng = random.Random(9)
    ops = [(rng.choice("ab"), v, rng.choice(["add", "add", "add", "del"]), rng.randrange(12), rng.choice(["x", "y", None])) for v in range(80)]
    ops += [("a", 30, "reset", 3, "r"), ("a", 30, "reset", 4, "r"), ("b", 70, "reset", None, None), ("a", 30, "add", 3, "z"), ("c", 1, "del", 1, None)]
    late = ops[:]
    rng.shuffle(late)
    late += late[:5]
    batches = [late[:30], late[30:50], late[50:]]
    done = run(spark, stateful.policy_outcomes(fed(spark, f"{tmp_path}/in", batches, OPS)), tmp_path)
    assert len(done) == sum(o[3] is not None for o in late)
    want = {(r.module, r.rule_id): (r.rule_content, r.version) for r in policy.folded(spark.createDataFrame(ops, OPS)).collect()}
    resets = {"a": 30, "b": 70}
    kept = {}
    for r in done:
        if (r.ok or r.msg == "unknown rule") and r.version >= resets.get(r.module, 0):
            rank = (r.version, r.cmd == "del", r.rule_content or "")
            kept[r.module, r.rule_id] = max(kept.get((r.module, r.rule_id), rank), rank)
    assert {k: (c or None, v) for k, (v, gone, c) in kept.items() if not gone} == want
    assert {r.msg for r in done} == {None, "late", "repeated", "unknown rule"} and all((r.msg is None) == r.ok for r in done)


def test_reports_list_successes_and_failures(spark):
    done = spark.createDataFrame([("m", 1, "add", 2, True, None), ("m", 1, "add", 1, True, None), ("m", 2, "del", 9, False, "x" * 300)], "module string, version long, cmd string, rule_id long, ok boolean, msg string")
    got = sorted(tuple(r) for r in policy.reports(done, F.lit("2024-01-01 00:00:00")).collect())
    assert got == [("2024-01-01 00:00:00", "policy", "add", "m", "1", [1, 2], []), ("2024-01-01 00:00:00", "policy", "del", "m", "2", [], [(9, "x" * 128)])]


def test_monitor_counters_of_a_stream_are_those_of_the_batches(spark, tmp_path):
    allowed = spark.createDataFrame([("10.0.0.0/8",), ("::1",)], "entry string")
    batches = [
        [("10.1.1.1",), ("8.8.8.8",), ("8.8.8.8",), (None,), ("",), ("0.0.0.0",)], [("10.2.2.2",), ("127.0.0.1",)],
        [("8.8.8.8",), ("9.9.9.9",), ("2001:db8::1",)],
    ]
    feed = fed(spark, str(tmp_path / "in"), batches, "remote_ip string")
    seen = lambda df: monitor.network_seen(df, allowed)
    put = monitor.sink(str(tmp_path / "out"), seen)

    def twice(df, batch):  # a repeated batch counts once
        put(df, batch)
        put(df, batch)

    streams.run_to(feed, twice, str(tmp_path / "checkpoint")).awaitTermination(200)
    got = sorted(map(tuple, monitor.streamed(spark, str(tmp_path / "out"), once=True).collect()))
    assert got == [(0, 1, 6, 1), (1, 2, 8, 1), (2, 3, 11, 3)]
    rows = spark.createDataFrame([(i, *r) for i, b in enumerate(batches) for r in b], "batch long, remote_ip string")
    whole = monitor.totals(monitor.counted(rows), seen(rows), once=True)
    assert sorted(map(tuple, whole.collect())) == got
    named = sorted(map(tuple, monitor.blocked(spark, str(tmp_path / "out")).collect()))
    assert named == [("2001:db8::1", 2), ("8.8.8.8", 0), ("9.9.9.9", 2)]


def test_monitor_counts_every_odd_check(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string")
    files = spark.createDataFrame([(0, "a", "1"), (0, "b", None), (1, "a", "x"), (1, "b", "2"), (2, "a", "x"), (2, "b", "y")], "batch long, path string, digest string")
    got = monitor.totals(monitor.counted(files), monitor.integrity_seen(files, base), once=False)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 1), (1, 2, 4, 2), (2, 3, 6, 4)]
    none = files.where("false")
    assert monitor.totals(monitor.counted(none), monitor.integrity_seen(none, base), once=False).count() == 0


def test_a_scan_of_many_files_is_few_micro_batches(spark, tmp_path, monkeypatch):
    from docsift.plans import queries

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    batches, put = [], streams.to_table
    monkeypatch.setattr(streams, "to_table", lambda path: lambda df, batch: (batches.append(batch), put(path)(df, batch)))
    got = queries.integrity_watch_alerts(spark, str(tmp_path)).collect()
    assert sum(r.n for r in got) > 200 and len(set(batches)) <= 5


def test_state_is_asked_once_a_rule_not_once_an_operation():
    import pandas as pd

    calls = []

    class Held:
        def __init__(self):
            self.value, self.rules = None, {}

        def exists(self):
            calls.append("exists")
            return self.value is not None or bool(self.rules)

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            self.value = value

        def containsKey(self, k):  # noqa: N802
            calls.append("contains")
            return k in self.rules

        def getValue(self, k):  # noqa: N802
            calls.append("value")
            return self.rules[k]

        def updateValue(self, k, v):  # noqa: N802
            calls.append("update")
            self.rules[k] = v

    class Handle:
        getValueState = getMapState = lambda self, *a: Held()

    p = stateful._Policy()
    p.init(Handle())
    for start, ok in ((0, 4998), (5000, 5000)):  # rules 3 and 7 are deleted before they are added
        calls.clear()
        ops = pd.DataFrame({"version": range(start, start + 5000), "cmd": ["add", "add", "add", "del"] * 1250, "rule_id": [i % 10 for i in range(5000)], "rule_content": "c"})
        out = pd.concat(p.handleInputRows(("m", 0), iter([ops]), None))
        assert len(out) == 5000 and out["ok"].sum() == ok and len(calls) <= 40
    assert {k: v[0] for k, v in p.rules.rules.items()} == {(i,): 9990 + i for i in range(10)}


def test_large_rule_ids_stay_exact_beside_a_reset(spark, tmp_path):
    big = (1 << 60) + 1
    ops = [("a", 1, "reset", None, None), ("a", 2, "add", big, "x"), ("a", 3, "del", big, None), ("a", 4, "del", big, None)]
    done = run(spark, stateful.policy_outcomes(fed(spark, f"{tmp_path}/in", [ops], OPS)), tmp_path)
    assert sorted((r.version, r.rule_id, r.msg) for r in done) == [(2, big, None), (3, big, None), (4, big, "unknown rule")]
