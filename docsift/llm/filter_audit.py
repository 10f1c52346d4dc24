"""Filter interaction audit by direct relational replay.

Every document is reduced once to a row of flags: one bit for each filter that it fails, and its labels.
These rows meet a broadcast table of all orders of the filters (120 for five, whatever the input), each
pair is exploded into the steps of its order, the first failed step decides where the document goes, and
conditional counts are summed. Spark combines them within each task, so a task hands on one row for each
part, order and step it met, and no part or order gathers rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails the filters A to D; null counts as empty."""
    t = common.text_of(text)
    words = F.array_remove(F.split(t, SPACE), "")
    n, capitals = F.size(words), F.char_length(t) - F.char_length(F.regexp_replace(t, "[A-Z]+", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.char_length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def mask_of(conditions: dict[str, Column], filters: str) -> Column:
    """Bit i is set if the condition of filter i holds; a null condition doesn't."""
    bits = [F.when(c, F.lit(1 << filters.index(name))).otherwise(F.lit(0)) for name, c in conditions.items()]
    return sum(bits[1:], bits[0])


def later_copy(rows: DataFrame, id_col: str, digest_col: str) -> DataFrame:
    """rows with later: another row of a smaller id has the same digest. A null id is neither smaller nor larger.

    Only digests with several ids are joined; the least id of each is found by combining within tasks,
    and Spark splits the rows of a frequent digest in the left join.
    """
    copied = rows.groupBy(digest_col).agg(F.min(id_col).alias("_least"), F.max(id_col).alias("_last")).where("_least < _last")
    joined = rows.join(copied.drop("_last"), digest_col, "left")
    return joined.withColumn("later", F.coalesce(F.col(id_col) > F.col("_least"), F.lit(False))).drop("_least")


def orders(spark: SparkSession, filters: str) -> DataFrame:
    """(filter_order, order_no, bits): every order of the filters and the bit of the filter at each step."""
    rows = [("".join(o), i, [1 << filters.index(x) for x in o]) for i, o in enumerate(itertools.permutations(filters))]
    return spark.createDataFrame(rows, "filter_order string, order_no int, bits array<int>")


def replay(flagged: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    flagged: part string, mask int (bit i: fails filter i), good and toxic booleans, not null. filters:
    one letter each, at most six, so that the orders stay few. A row for every part, order and step;
    no rows without documents.
    """
    if not 1 <= len(filters) <= 6 or len(set(filters)) != len(filters):
        raise ValueError("filters: one to six different letters")
    every = F.broadcast(orders(flagged.sparkSession, filters))
    met = flagged.crossJoin(every)
    first = F.lit(len(filters) + 1)
    for k in range(len(filters), 0, -1):
        first = F.when(F.col("mask").bitwiseAND(F.col("bits")[k - 1]) != 0, F.lit(k)).otherwise(first)
    steps = met.withColumn("first", first).select(
        "part", "order_no", "mask", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")
    ).withColumn("step", F.col("at") + 1)
    removed = F.col("first") == F.col("step")
    counted = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": (F.col("mask").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step")),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = steps.groupBy("part", "order_no", "step").agg(*[F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(n) for n, c in counted.items()])
    named = sums.join(F.broadcast(orders(flagged.sparkSession, filters).select("order_no", "filter_order")), "order_no")
    of_filter = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return named.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(of_filter).alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five filters over whole documents, in all 120 orders, for each language.

    A null text is empty: it fails A alone (and E, as a copy). A null lang is the part of the empty
    string, like an empty lang. A null doc_id is no smaller id and has no label; repeated rows are
    documents each, and equal ids are not smaller than one another. Several labels of one doc_id: any
    quality or toxic of 1 counts. An empty table gives no rows; other columns are ignored.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    flags = common.written(docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask_of(failures(F.col("text")), "ABCDE").alias("mask"),
        F.unhex(F.sha2(common.text_of("text").cast("binary"), 256)).alias("digest"),
    ))
    labels = common.table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic")
    )
    copies = later_copy(flags, "doc_id", "digest").drop("digest")
    no = F.lit(False)
    flagged = copies.join(labels, "doc_id", "left").select(
        "part", (F.col("mask") + F.when(F.col("later"), F.lit(16)).otherwise(F.lit(0))).alias("mask"),
        F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"),
    )
    return replay(flagged, "ABCDE")


ORACLE_SQL = r"""
WITH w AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), f AS (
    SELECT doc_id, part,
        CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM w
), l AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), d AS (
    SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)
), x AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), o AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM x a, x b, x c, x d, x e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s AS (
    SELECT part, filter_order, step, bits[step] AS bit, mask, good, toxic,
        CASE WHEN mask & bits[1] > 0 THEN 1 WHEN mask & bits[2] > 0 THEN 2 WHEN mask & bits[3] > 0 THEN 3
             WHEN mask & bits[4] > 0 THEN 4 WHEN mask & bits[5] > 0 THEN 5 ELSE 6 END AS first
    FROM d, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), g AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step,
        count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
        count(*) FILTER (mask & bit > 0 AND first < step) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
        count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
    FROM s GROUP BY ALL
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substring(filter_order, step, 1)) AS BIGINT) AS shapley FROM g
"""
