"""Helpers shared by the operators: tables on shared storage, connected components, packed ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import shared_dir, shuffles_deleted


def written(df: DataFrame, parts: int | None = None) -> DataFrame:
    """df as a Parquet table on shared storage: lineage ends there and lost executors lose nothing. parts: files at most."""
    path = shared_dir(df.sparkSession)
    with shuffles_deleted(df.sparkSession):
        (df if parts is None else df.coalesce(parts)).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docsift_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_docsift_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with name, distinct longs that hold whenever they are read: a row's file and its place there.

    A table of Parquet files is numbered as it lies; anything else is stored first.
    """
    try:
        if "_metadata" in df.columns or df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
            raise AnalysisException("not the rows of files as they are")
        at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        return written(df.withColumn(name, F.monotonically_increasing_id()))
    files = written(at.select("_file").distinct().withColumn("_n", F.row_number().over(Window.orderBy("_file"))))  # a row for each file
    number = F.shiftleft(F.col("_n").cast("long"), 40) + F.col("_place")
    return at.join(F.broadcast(files), "_file").select(*df.columns, number.alias(name))


def marks(ids: DataFrame, name: str, *by: str) -> DataFrame:
    """(block, by.., mask): the longs of column name, 64 to a mask, stored. So a row's choice is a bit or a few, which Spark broadcasts by size."""
    bit = F.expr(f"shiftleft(1L, cast(`{name}` & 63 AS INT))")
    return written(ids.groupBy(F.shiftright(name, 6).alias("block"), *by).agg(F.bit_or(bit).alias("mask")))


def chosen(rows: DataFrame, name: str, marks: DataFrame) -> DataFrame:
    """The rows whose long in column name is marked, once for each mask that has it: rows needn't move for it."""
    m = marks.select(F.col("block").alias("_block"), F.col("mask").alias("_mask"))
    met = rows.join(m, (F.shiftright(name, 6) == F.col("_block")) & (F.getbit("_mask", F.col(name).bitwiseAND(F.lit(63)).cast("int")) == 1))
    return met.drop("_block", "_mask")


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null id: fold of the empty text)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds


EDGES = 1_000_000


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b) of longs; component is the smallest node of the class.

    Contraction: every node moves to the neighbour (or itself) of lowest random rank, edges follow,
    loops vanish. Ranks hold for three rounds, so a group around a leader needs two, a clique one; then
    they are drawn anew, so chains shrink by a constant factor. Nodes without an edge to another node
    don't appear. Tables get a file for each EDGES edges that were left, so late rounds are few tasks.
    """
    cur = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moved, turn = None, 0
    files = lambda n: max(6, n // EDGES)
    first = files(cur.count())
    while left := cur.count():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn // 3), F.col(c)).alias("r"), F.col(c).alias("v"))
        up = written(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(F.col("m"), rank("a")).getField("v").alias("to")), files(left)
        )
        step = up.withColumnRenamed("node", "label")
        last = moved
        moved = written(
            up.withColumnRenamed("to", "label") if moved is None
            else moved.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), first
        )
        e1 = cur.join(up.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
        e2 = e1.join(up.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        new = written(
            e2.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), files(left)
        )
        discard(cur, up, last)
        cur, turn = new, turn + 1
    if moved is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = moved.groupBy("label").agg(F.min("node").alias("component"))
    return moved.join(least, "label").select("node", "component")
