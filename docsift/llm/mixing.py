"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Slots of equal token counts are dealt to sources: slot i is the golden-ratio point i * 2654435769 mod
2^32, which falls into one source's share of the cumulative targets. The slots of a source are ranked;
rank r takes block r of that source's stream, which is the source's documents in hashed order, cut into
blocks of as many tokens, three times over at most. A source has as many blocks as its target fills, the
last in part: slots dealt beyond them stay empty, and blocks that no slot was dealt to (a few at most)
follow at the end of the mix. So every stretch of the mix holds the sources close to their targets, and
every source takes its target to the word, however small it is beside a block.

Offsets and ranks are prefix sums in two levels (a hash range or a run of slots at a time, then their
totals), so a source with most rows is spread over many tasks. Texts are only read to count words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SLOTS = 200_000
MOST_TOKENS = 2048
GOLDEN = 2654435769
RUN = 1 << 16
RANGES = 1024


def words(text: Column) -> Column:
    """Runs of other than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh as weights in turn and share all sizes; a target stops at
    epochs times its source's size, and what is over goes to the others by weight. The fixed point needs
    no rounds: by rising size per weight, the sources before the first that its share doesn't fill are
    full, and the rest share what they leave.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w)
    s = s.withColumn("most", F.col("source_size") * F.lit(float(epochs)))
    rising = Window.orderBy(F.col("most") / F.col("w"), "rank")
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(every)
    s = s.withColumn("found", level)
    return s.select("source", "rank", "source_size", F.least("most", F.col("w") * F.coalesce("found", F.lit(0.0))).alias("target"))


def _shares(sources: DataFrame) -> DataFrame:
    """targets() with lo and hi, the source's part of the points 0..2^32-1."""
    up = Window.orderBy("rank")
    total = F.sum("target").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = lambda end: F.coalesce(F.floor(F.try_divide(F.sum("target").over(up.rowsBetween(Window.unboundedPreceding, end)), total) * F.lit(float(1 << 32))), F.lit(0))
    return sources.withColumn("lo", at(-1)).withColumn("hi", F.when(F.lead("rank").over(up).isNull(), F.lit(1 << 32)).otherwise(at(0))).withColumn("all", F.coalesce(total, F.lit(0.0)))


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """(slot, rank, block): the source and its block of every slot of the mix. sources: rank, lo, hi."""
    point = (F.col("slot") % F.lit(1 << 32)) * F.lit(GOLDEN) % F.lit(1 << 32)
    dealt = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).join(
        F.broadcast(sources.select("rank", "lo", "hi")), (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))
    ).select("slot", "rank", F.floor(F.col("slot") / RUN).alias("run"))
    runs = dealt.groupBy("rank", "run").agg(F.count("*").alias("c"))
    up = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select("rank", "run", F.coalesce(F.sum("c").over(up), F.lit(0)).alias("base"))
    own = Window.partitionBy("rank", "run").orderBy("slot")
    return dealt.withColumn("r", F.row_number().over(own)).join(base, ["rank", "run"]).select(
        "slot", "rank", (F.col("base") + F.col("r") - 1).alias("block")
    )


def streamed(docs: DataFrame) -> DataFrame:
    """docs (id, source, size, h) with start, the offset of a document in its source's hashed order."""
    d = docs.withColumn("range", F.shiftrightunsigned("h", 64 - (RANGES.bit_length() - 1)))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("s"))
    up = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("s2"), F.col("range").alias("r2"), F.coalesce(F.sum("s").over(up), F.lit(0)).alias("base"))
    own = Window.partitionBy("source", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = d.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return within.join(base, F.col("source").eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2"))).withColumn(
        "start", F.col("base") + F.col("before")
    ).drop("s2", "r2", "range", "before", "base")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, slots: int = SLOTS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken (words the mix takes, repeats counted), first_slot.

    first_slot is the first slot of the mix that holds words of the document; null where none does or only
    blocks that follow all slots. The taken words of a source are its target, rounded.
    A null text has no words and is never taken; null sources form one source, the last. Repeated rows
    are documents of their own. Reruns agree, however rows are partitioned. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = common.written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.lit(17)).alias("h")))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = common.written(_shares(targets(sizes, weights, epochs)))
    first = sources.agg(F.max("all").alias("all")).first()
    total = int(round(first["all"] or 0))
    tokens = min(max(1, total // slots), MOST_TOKENS)
    named = streamed(d).withColumnRenamed("source", "own").join(
        sources, F.col("own").eqNullSafe(F.col("source"))
    ).select("id", "rank", "size", "h", "start", "source_size", "target")
    placed = common.written(named.withColumn("row", F.monotonically_increasing_id()))
    common.discard(d)
    slots_of = schedule(spark, sources, -(-total // tokens))
    held = placed.where("size > 0").select("row", "rank", "size", F.round("target").cast("long").alias("most"), F.explode(F.expr(f"transform(sequence(0, {epochs - 1}), e -> e * source_size + start)")).alias("at")).where("at < most")
    held = held.withColumn("to", F.least(F.col("at") + F.col("size"), F.col("most")))
    parts = held.select("row", "rank", "at", "to", F.explode(F.sequence(F.floor(F.col("at") / tokens), F.floor((F.col("to") - 1) / tokens))).alias("block"))
    cut = parts.withColumn("n", F.least(F.col("to"), (F.col("block") + 1) * tokens) - F.greatest(F.col("at"), F.col("block") * tokens))
    taken = cut.join(slots_of, ["rank", "block"], "left").groupBy("row").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot"
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for every row of documents.

    Null and blank texts have no words and are never taken; null sources form one source, the last; equal
    ids and repeated rows are documents each; ties in the hashed order go by id, then size; an empty table
    gives no rows; other columns are ignored.
    """
    return mix(common.table(spark, sf_dir, "documents"))
