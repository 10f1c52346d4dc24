"""Stores of typed records on shared storage: pushed whole, popped front first, deleted once delivered.

The first records of a store, up to its limit, are its front; what comes while the front is full is spilled.
A flush puts the front behind what was spilled before, and a new front begins. Popped records come front
first, then spilled ones in the order they went down. Which records are the front follows from the order of
arrival alone, so a push is one write of encrypted rows and counts nothing before it.

One process pushes to a path at a time. Columns that records are ordered by are the only ones not encrypted
while Spark sorts them; they are not stored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import exists

# How many records the front of each store holds. Alert logs have none.
LIMITS = {"alerts": 100, "audit_logs": 200, "security_reports": 50, "command_results": 50, "policy_results": 50, "alert_logs": 0}
ROW = "store string, push bigint, since bigint, row bigint, data binary"


@dataclass(frozen=True)
class Popped:
    """records: store, front, line (sorts a store's records) and record, a struct. pushes: the tables read."""

    records: DataFrame
    pushes: tuple[str, ...]


class Stores:
    """Stores by name below one folder. A name without a limit, null included, is an error; a limit of 0 spills all."""

    def __init__(self, spark: SparkSession, path: str, key: bytes, limits: dict[str, int] | None = None):
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.limits = dict(LIMITS if limits is None else limits)
        if any(n < 0 for n in self.limits.values()):
            raise ValueError("a limit is 0 or more")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> tuple[list[str], int, int]:
        """Names of committed pushes in order, the number of the last flush (0: none), the next free number."""
        if not exists(self.spark, self.path):
            return [], 0, 1
        at, fs = self._at("")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at))
        numbers = {n: int(n[1:].split("-")[0]) for n in names if n[0] in "pf"}
        pushes = [n for n in numbers if n[0] == "p" and exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        flushes = [k for n, k in numbers.items() if n[0] == "f"]
        return pushes, max(flushes, default=0), max(numbers.values(), default=0) + 1

    def _delete(self, name: str) -> None:
        at, fs = self._at(name)
        fs.delete(at, True)

    def push(self, records: DataFrame, store: str, order: list[str]) -> None:
        """Records join the line of the store that column store names, by order; ties follow one another anyhow.

        The push counts whole or, if it fails, not at all. Repeated records stay.
        """
        _, since, number = self._listed()
        known = F.coalesce(F.col(store).isin(*self.limits), F.lit(False))
        named = F.when(known, F.col(store)).otherwise(F.raise_error(F.concat(F.lit("no such store: "), F.coalesce(F.col(store).cast("string"), F.lit("null")))))
        data = F.aes_encrypt(F.to_json(F.struct(*records.columns)).cast("binary"), F.lit(self.key))
        rows = records.select(named.alias("store"), F.struct(*order).alias("at"), data.alias("data"))
        line = rows.repartitionByRange("store", "at").sortWithinPartitions("store", "at")
        out = line.select("store", F.lit(number).cast("bigint").alias("push"), F.lit(since).cast("bigint").alias("since"), F.monotonically_increasing_id().alias("row"), "data")
        name = f"p{number:012d}-{uuid.uuid4().hex}"
        try:
            out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}")
        except BaseException:
            self._delete(name)
            raise

    def flush(self) -> None:
        """The front of every store goes behind what it spilled; later records make a new front."""
        _, before, number = self._listed()
        at, fs = self._at(f"f{number:012d}")
        fs.mkdirs(at)
        if before:
            self._delete(f"f{before:012d}")

    def pop(self, schema: str) -> Popped:
        """All records pushed by now. They stay until clear, so a delivery that fails can be done again.

        Records that the key does not open are skipped, but keep their place in the count of the front.
        """
        pushes, flushed, _ = self._listed()
        rows = self.spark.createDataFrame([], ROW)
        if pushes:
            rows = self.spark.read.schema(ROW).parquet(*[f"{self.path}/{n}" for n in pushes])
        record = F.from_json(F.try_aes_decrypt("data", F.lit(self.key)).cast("string"), schema)
        placed = self._fronts(rows)
        front = F.col("first") & (F.col("since") == flushed)
        line = F.struct((~front).alias("spilled"), "since", "first", "push", "row")
        read = placed.select("store", front.alias("front"), line.alias("line"), record.alias("record"))
        return Popped(read.where("record is not null"), tuple(pushes))

    def _fronts(self, rows: DataFrame) -> DataFrame:
        """rows with first: among the first of their store since a flush, up to its limit.

        The window's limit is applied in each task before rows meet, so a store of any size sends few. Where a
        front ends is a row for each store and flush, which is broadcast: the records stay where they are.
        """
        most = max(self.limits.values(), default=0)
        by = Window.partitionBy("store", "since").orderBy("push", "row")
        ids = rows.select("store", "since", "push", "row").withColumn("n", F.row_number().over(by)).where(F.col("n") <= most)
        ends = ids.where(F.col("n") <= self._limit()).groupBy("store", "since").agg(F.max(F.struct("push", "row")).alias("end"))
        first = F.coalesce(F.struct("push", "row") <= F.col("end"), F.lit(False))
        return rows.join(F.broadcast(ends), ["store", "since"], "left").withColumn("first", first).drop("end")

    def _limit(self) -> Column:
        limit = F.lit(0)
        for name, n in self.limits.items():
            limit = F.when(F.col("store") == name, n).otherwise(limit)
        return limit

    def clear(self, popped: Popped) -> None:
        """Deletes what was popped, and nothing that was pushed since."""
        for name in popped.pushes:
            self._delete(name)
