"""Streams with state of their own: the integrity watch with its clock, and policies applied operation by operation."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 16
PATH_BUCKETS = 256


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which timers and map state need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _some(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows as one frame; nothing without rows."""
    if len(rows):
        yield rows


class _Watch(StatefulProcessor):
    """The baseline's paths of one bucket: what their digests should be, and the ticks at which they count as gone unless seen.

    The bucket is read and written whole, once for what comes in and once when its earliest tick is over,
    and worked out as columns: a call of the state for each path took most of the time.
    """

    def __init__(self, every_ms: int):
        self.every = every_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "paths binary, timer long")

    def _paths(self) -> tuple[pd.DataFrame, int | None]:
        """path, expected and due, and the timer that is set."""
        if not self.state.exists():
            return pd.DataFrame({"path": [], "expected": [], "due": []}).astype({"path": object, "expected": object, "due": "int64"}), None
        held, timer = self.state.get()
        rows = pa.ipc.open_stream(bytes(held)).read_all()
        return pd.DataFrame({"path": rows["path"].to_numpy(), "expected": rows["expected"].to_numpy(), "due": rows["due"].to_numpy()}), timer

    def _keep(self, paths: pd.DataFrame, before: int | None) -> None:
        due = int(paths["due"].min())
        if before != due:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        rows = pa.table({"path": pa.array(paths["path"], pa.string()), "expected": pa.array(paths["expected"], pa.string()), "due": pa.array(paths["due"], pa.int64())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema) as to:
            to.write_table(rows)
        self.state.update((out.getvalue().to_pybytes(), due))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        paths, before = self._paths()
        new = pd.DataFrame({"path": initialState["path"].astype(object), "expected": initialState["digest"].astype(object), "due": initialState["since_ms"].astype("int64") + self.every})
        self._keep(pd.concat([paths, new]).drop_duplicates("path"), before)

    def _missed(self, path: np.ndarray, due: np.ndarray, until: np.ndarray) -> pd.DataFrame:
        """A deletion for each tick from due on and before until."""
        n = np.maximum(0, -((due - until) // self.every))
        turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pd.DataFrame({"path": np.repeat(path, n), "at_ms": np.repeat(due, n) + turn * self.every, "state": "deleted"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        paths, before = self._paths()
        seen = pd.concat(list(rows)).sort_values("at_ms", kind="stable")
        path, digest, t = seen["path"].to_numpy(object), seen["digest"].to_numpy(object), seen["at_ms"].to_numpy("int64")
        at = pd.Index(paths["path"]).get_indexer(path)
        known = at >= 0
        none, other = pd.isna(digest), np.ones(len(t), bool)
        other[known] = digest[known] != paths["expected"].to_numpy()[at[known]]
        state = np.where(~known, "added", np.where(none, "unreadable", "modified"))
        odd = ~known | none | other
        yield from _some(pd.DataFrame({"path": path[odd], "at_ms": t[odd], "state": state[odd]}))
        if not len(paths):
            return
        at, t = at[known], t[known]
        due = paths["due"].to_numpy().copy()
        last = pd.Series(t).groupby(at).shift(1)  # a path seen before within these rows isn't due until a tick after that
        start = np.maximum(due[at], np.where(last.isna(), due[at], last.fillna(0).astype("int64") + self.every))
        yield from _some(self._missed(paths["path"].to_numpy(object)[at], start, t))
        np.maximum.at(due, at, t + self.every)
        self._keep(paths.assign(due=due), before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        paths, _ = self._paths()
        due, over = paths["due"].to_numpy(), timerValues.getCurrentWatermarkInMs() + 1
        yield from _some(self._missed(paths["path"].to_numpy(object), due, np.full(len(due), over)))
        self._keep(paths.assign(due=due + np.maximum(0, -((due - over) // self.every)) * self.every), None)

    def close(self) -> None:
        pass


def integrity_watch(scans: DataFrame, baseline: DataFrame, every_ms: int, late: str = "0 seconds") -> DataFrame:
    """A stream of alerts (path, at, state), one for each tick at which a path differs from the baseline.

    scans: a stream of (path, digest, at timestamp): what a scan found at its tick; a null digest is a file
    that could not be read. baseline: (path, digest, since timestamp). A path of the baseline that no scan
    up to a tick has seen is deleted, at every tick until it is seen again; the others are modified,
    unreadable or, if the baseline has no such path, added, at every tick they are seen. Absence is known
    when the watermark (late behind the newest scan) passes the tick. State: the baseline's paths, dealt to
    PATH_BUCKETS tables by their hash.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(PATH_BUCKETS)).cast("int").alias("bucket")
    rows = scans.withWatermark("at", late).select(bucket, "path", "digest", "at", F.unix_millis("at").alias("at_ms"))
    known = baseline.select(bucket, "path", "digest", F.unix_millis("since").alias("since_ms")).groupBy("bucket")
    found = rows.groupBy("bucket").transformWithStateInPandas(
        _Watch(every_ms), "path string, at_ms long, state string", "Append", "EventTime", initialState=known
    )
    return found.select("path", F.timestamp_millis("at_ms").alias("at"), "state")


class _Policy(StatefulProcessor):
    """The rules of one module and bucket with the version that set them, deleted ones as marks until a reset.

    The operations of a micro-batch are worked out as columns: in order of (version, deletion, content) each
    distinct one on a rule is applied unless what is held is as new, so the state is read and written once a
    rule, not once an operation. What is held is never older than the last reset.
    """

    def init(self, handle) -> None:
        self.reset = handle.getValueState("reset", "version long")
        self.rules = handle.getMapState("rules", "rule_id long", "version long, deleted boolean, content string")

    def _held(self, rules: np.ndarray) -> pd.DataFrame:
        """version, deleted and content held of each rule; version is null where there is none."""
        rows = [self.rules.getValue((r,)) if self.rules.containsKey((r,)) else (None, None, None) for r in rules.tolist()] if self.rules.exists() else [(None,) * 3] * len(rules)
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip(("version", "deleted", "content"), zip(*rows))})

    def _cleared(self, versions: np.ndarray) -> int | None:
        """The last reset before these operations; theirs is kept and what is older goes."""
        before = self.reset.get()[0] if self.reset.exists() else None
        if len(versions) and (before is None or versions.max() > before):
            last = int(versions.max())
            self.reset.update((last,))
            for (rule,) in [k for k, v in self.rules.iterator() if v[0] < last]:
                self.rules.removeKey((rule,))
        return before

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ops = pd.concat(list(rows), ignore_index=True)
        clear = (ops["cmd"] == "clear").to_numpy()
        clears = np.unique(ops["version"].to_numpy("int64")[clear])
        ops = ops[~clear]
        rule, at = np.unique(ops["rule_id"].to_numpy("int64"), return_inverse=True)
        held = self._held(rule) if len(rule) else None
        before = self._cleared(clears)
        if not len(rule):
            return
        content = ops["rule_content"].to_numpy(object)
        content = np.where(pd.isna(content), None, content)
        code, texts = pd.factorize(np.concatenate([content, held["content"].to_numpy(object)]))
        rank = np.zeros(len(texts) + 1, "int64")  # null and empty are alike, the least
        rank[:-1] = np.unique(np.append(texts.astype(object), ""), return_inverse=True)[1][:-1]
        rank, was_rank = np.split(rank[code], [len(ops)])
        version, gone = ops["version"].to_numpy("int64"), (ops["cmd"] == "del").to_numpy()
        order = np.lexsort((rank, gone, version, at))
        at, version, gone, rank, content = at[order], version[order], gone[order], rank[order], content[order]
        known = held["version"].notna().to_numpy()
        was = held["version"].where(known, 0).astype("int64").to_numpy(), held["deleted"].where(known, False).astype(bool).to_numpy(), was_rank
        v, d, c = (x[at] for x in was)
        same = known[at] & (version == v) & (gone == d) & (rank == c)
        older = known[at] & ((version < v) | (version == v) & ((gone < d) | (gone == d) & (rank < c)))
        again = np.zeros(len(at), bool)
        again[1:] = (at[1:] == at[:-1]) & (version[1:] == version[:-1]) & (gone[1:] == gone[:-1]) & (rank[1:] == rank[:-1])
        late = older | (version < before if before is not None else False)
        repeated = ~late & (same | again)
        done = np.flatnonzero(~late & ~repeated)
        r, first, last = at[done], np.ones(len(done), bool), np.ones(len(done), bool)
        first[1:] = last[:-1] = r[1:] != r[:-1]
        prior = np.roll(done, 1)  # the operation applied to the rule before, else what is held
        old_version, old_gone, old = np.where(first, was[0][r], version[prior]), np.where(first, was[1][r], gone[prior]), ~first | known[r]
        n = np.searchsorted(clears, version[done], "right")
        since = np.append(np.iinfo("int64").min, clears)[n]  # of these resets the last up to the operation
        unknown = np.zeros(len(at), bool)
        unknown[done] = gone[done] & (~old | old_gone | (old_version < since))
        kept = done[last]
        for i in kept[version[kept] >= clears[-1]] if len(clears) else kept:
            self.rules.updateValue((int(rule[at[i]]),), (int(version[i]), bool(gone[i]), content[i]))
        msg = np.where(late, "late", np.where(repeated, "repeated", np.where(unknown, "unknown rule", None)))
        yield pd.DataFrame({
            "module": key[0], "version": version, "cmd": ops["cmd"].to_numpy(object)[order], "rule_id": rule[at], "rule_content": content, "ok": pd.isna(msg), "msg": msg,
        })

    def close(self) -> None:
        pass


def policy_outcomes(ops: DataFrame) -> DataFrame:
    """A stream of (module, version, cmd, rule_id, rule_content, ok, msg): what became of every operation on a rule.

    ops: a stream of (module, version long, cmd add|del|reset, rule_id, rule_content). Operations of one
    micro-batch are applied in order of version; later ones may be older, and then fail as late, unless
    nothing newer has touched their rule. The rules in force so are those that policy.folded() finds,
    whatever the order of arrival. Repeated operations fail as repeated, deleting a rule that isn't in
    force as unknown rule. A reset (null rule_id: to no rules) reaches every bucket of its module; the
    rules of a module are dealt to buckets by rule_id, so a large module is not one task's.
    """
    one = F.when(F.col("cmd") == "reset", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    parts = ops.select("module", "version", "cmd", "rule_id", "rule_content", F.explode(one).alias("clears"))
    own = F.array(F.pmod(F.xxhash64("rule_id"), F.lit(BUCKETS)).cast("int"))
    dealt = parts.where(F.col("clears") | F.col("rule_id").isNotNull()).select(
        "module", "version", F.when(F.col("clears"), "clear").otherwise(F.col("cmd")).alias("cmd"), F.when(~F.col("clears"), F.col("rule_id")).otherwise(-1).cast("bigint").alias("rule_id"),
        F.when(~F.col("clears"), F.col("rule_content")).alias("rule_content"),
        F.explode(F.when(F.col("clears"), F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(own)).alias("bucket"),
    )
    out = "module string, version long, cmd string, rule_id long, rule_content string, ok boolean, msg string"
    return dealt.groupBy("module", "bucket").transformWithStateInPandas(_Policy(), out, "Append", "None")
