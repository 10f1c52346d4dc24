"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A fingerprint is a wide vector summed over the paragraphs (the pieces between line feeds) of a text,
so it does not depend on their order, and adding or subtracting a paragraph's vector inserts or
deletes it. A paragraph's vector has two parts:

* the 8 words of 32 bits of its SHA-256, summed modulo 2^32: equal multisets of paragraphs have equal
  sums; others differ but for a chance of 2^-256 (texts made up to collide are another matter);
* for likeness, 128 counters, summed from the paragraph's pieces: how often each of 128 bits of the
  pieces' hashes was set. Two counters of 32 bits share a word, which is enough for any text that Spark
  holds; one more word counts the pieces. A counter as set minus unset bits is a sum of random signs, so
  the squared distance of two fingerprints estimates how many pieces differ.

Pieces are all pairs of neighbouring tokens of a paragraph with what is between them, and its last token
alone. A token is a run of up to RUN characters other than white space; characters of scripts written
without spaces get a blank on either side first.
Likeness is 1 - |x - y|^2 / (|x|^2 + |y|^2), within 0 and 1: the part of pieces in common.

An edited text's fingerprint is made by deletion and insertion: only paragraphs from the edit on are
hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EXACT, HASHES, RUN = 8, 2, 32
_ALONE = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
_TOKEN = rf"\S{{1,{RUN}}}+"
PIECE = rf"(?=({_TOKEN}(?:[^\S\n]*+{_TOKEN})?)){_TOKEN}"
_WORDS = [f"l{h}_{j}" for h in range(HASHES) for j in range(32)] + ["n"]
_LENGTH = EXACT + len(_WORDS)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


_LOW = 0xFFFFFFFF


def _exact(text: Column) -> Column:
    """The paragraphs' SHA-256 words, summed; null has no paragraph."""
    digests = F.coalesce(F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p.cast("binary"), 256)), F.array().cast("array<string>"))
    word = lambda d, k: F.conv(F.substring(d, 8 * k + 1, 8), 16, 10).cast("long")
    words = F.transform(digests, lambda d: F.array(*[word(d, k) for k in range(EXACT)]))
    return F.aggregate(words, F.array_repeat(_long(0), EXACT), lambda s, w: F.zip_with(s, w, lambda a, b: (a + b).bitwiseAND(_long(_LOW))))


def _spaced(text: Column) -> Column:
    """The text with blanks around characters of scripts written without them."""
    plain = (F.octet_length(text) == F.char_length(text)) | ~F.rlike(text, F.lit(_ALONE))
    return F.when(plain, text).otherwise(F.regexp_replace(text, f"({_ALONE})", " $1 "))


def _counted(texts: DataFrame, by: list[str], text: str = "x") -> DataFrame:
    """by (which is distinct) and c, the counters of the text's pieces; no row for a text without any."""
    pieces = texts.select(*by, F.explode(F.regexp_extract_all(_spaced(F.col(text)), F.lit(PIECE), F.lit(1))).alias("piece"))
    first = pieces.select(*by, F.xxhash64("piece").alias("u0"))
    hashed = first.select(*by, "u0", *[F.xxhash64(F.lit(k), "u0").alias(f"u{k}") for k in range(1, HASHES)])
    pair = _long(1 + (1 << 32))
    sums = [F.sum(F.shiftrightunsigned(f"u{h}", j).bitwiseAND(pair)).alias(f"l{h}_{j}") for h in range(HASHES) for j in range(32)]
    return hashed.groupBy(*by).agg(*sums, F.count("*").alias("n")).select(*by, F.array(*_WORDS).alias("c"))


def _or_none(c: str) -> Column:
    """The counters, or those of no piece."""
    return F.coalesce(c, F.array_repeat(_long(0), len(_WORDS)))


def to_hex(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _lanes(v: Column) -> Column:
    """The counters as set minus unset bits."""
    n = F.element_at(v, _LENGTH).cast("double")
    return F.flatten(F.transform(F.slice(v, EXACT + 1, 32 * HASHES), lambda w: F.array(*[
        2.0 * F.shiftrightunsigned(w, 32 * k).bitwiseAND(_long(_LOW)).cast("double") - n for k in range(2)
    ])))


def likeness(x: Column, y: Column) -> Column:
    """Likeness of two fingerprint vectors, 0 to 1; 1 if all words are equal."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e * e)
    a, b = _lanes(x), _lanes(y)
    both = square(a) + square(b)
    apart = square(F.zip_with(a, b, lambda p, q: p - q))
    return F.when(x == y, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - apart / both))


def added(x: Column, y: Column, sign: int = 1) -> Column:
    """The vector after paragraphs with vector y are inserted into x (sign 1) or deleted from it (-1)."""
    sums = F.zip_with(x, y, lambda p, q: p + q * sign)
    return F.transform(sums, lambda e, i: F.when(i < EXACT, e.bitwiseAND(_long(_LOW))).otherwise(e))


def vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and v, the vector, for every row; null text counts as empty, that is one empty paragraph.

    Equal texts are hashed once; rows are joined to their texts' vectors.
    """
    t = common.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("k"), F.xxhash64(F.lit(1), t).alias("h"), t.alias("x"))
    texts = rows.select("k", "h", "x").dropDuplicates(["k", "h"])
    whole = texts.select("k", "h", _exact(F.col("x")).alias("e")).join(_counted(texts, ["k", "h"]), ["k", "h"], "left")
    return rows.select("id", "k", "h").join(whole, ["k", "h"]).select(F.col("id").alias(id_col), F.concat("e", _or_none("c")).alias("v"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (hexadecimal digits of vectors()) for every row."""
    return vectors(docs, id_col, text_col).select(id_col, to_hex(F.col("v")).alias("fingerprint"))


def previous(ids: DataFrame) -> DataFrame:
    """(id, h) with the row before it in descending order (p_id, p_h, p_n), around the ends; no single task sees all."""
    order = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    spark = ids.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.written(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    row = F.struct("id", "h", "n")
    w = Window.partitionBy("part").orderBy(*order)
    inner = dealt.withColumn("p", F.lag(row).over(w))
    last = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), F.col("h").asc())
    tails = dealt.withColumn("k", F.row_number().over(last)).where("k = 1").select("part", row.alias("tail"))  # a row for each partition
    every = Window.orderBy("part")
    ring = tails.select("part", F.coalesce(F.lag("tail").over(every), F.last("tail").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return inner.join(F.broadcast(ring), "part").withColumn("p", F.coalesce("p", "before")).select(
        "id", "h", F.col("p.id").alias("p_id"), F.col("p.h").alias("p_h"), F.col("p.n").alias("p_n")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row against an edit of itself and against its successor by descending id.

    The edit replaces the last third of the code points by the first as many (or all) of the next
    text; after the smallest id comes the largest. Returns id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null text counts as empty; null ids come last; rows of
    one id follow each other by descending text hash; repeated rows count once in the order and all get
    its result. Other columns are ignored.
    """
    t = common.text_of(text_col)
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))
    ids = src.select("id", "h", F.char_length("t").cast("long").alias("n")).groupBy("id", "h").agg(F.first("n").alias("n"))
    key = ["k", "h"]
    before = common.written(previous(ids).select(
        F.xxhash64("id").alias("k"), "h", F.xxhash64("p_id").alias("p_k"), "p_h", "p_n"))
    texts = src.select(F.xxhash64("id").alias("k"), "h", "t").dropDuplicates(key).join(before, key)
    heads = texts.select(F.col("p_k").alias("k"), F.col("p_h").alias("h"), F.substring(F.col("t"), F.lit(1), _third(F.col("p_n"))).alias("head"))
    n = F.char_length("t")
    stays = F.substring(F.col("t"), F.lit(1), n - _third(n))
    both = texts.join(heads, key).select(*key, "p_k", "p_h", n.cast("long").alias("n_chars"), "t", stays.alias("stays"), "head")
    both = both.withColumn("rest", F.substring_index("stays", "\n", -1))  # of the paragraph that the edit cuts
    kept = F.char_length("stays") - F.char_length("rest")
    parts = {  # paragraphs before the cut one; the others as they were, and as they become
        "kept": F.when(kept > 0, F.substring(F.col("stays"), F.lit(1), kept - 1)),
        "old": F.substring(F.col("t"), kept + 1, n), "new": F.concat("rest", "head"),
    }
    each = both.select(*key, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), x.alias("x")) for p, x in parts.items()])).alias("s"))
    counts = _counted(each.select(*key, "s.part", "s.x"), [*key, "part"])
    count_of = [F.max(F.when(F.col("part") == p, F.col("c"))).alias(f"c_{p}") for p in parts]
    facts = both.select(
        *key, "p_k", "p_h", "n_chars", F.sha2(F.concat("stays", "head").cast("binary"), 256).alias("edited_sha256"),
        *[_exact(x).alias(f"e_{p}") for p, x in parts.items()],
    )
    vector = lambda p: F.concat(f"e_{p}", _or_none(f"c_{p}"))
    done = common.written(facts.join(counts.groupBy(*key).agg(*count_of), key, "left").select(
        *key, "p_k", "p_h", "n_chars", "edited_sha256", added(vector("kept"), vector("old")).alias("v"), added(vector("kept"), vector("new")).alias("ev")
    ))
    nexts = done.select(F.col("p_k").alias("k"), F.col("p_h").alias("h"), F.col("v").alias("nv"))
    result = done.join(nexts, key).select(
        *key, "n_chars", "edited_sha256", to_hex(F.col("v")).alias("fingerprint"), to_hex(F.col("ev")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("ev")).alias("near_edited"), likeness(F.col("v"), F.col("nv")).alias("near_next"),
    )
    return src.select("id", F.xxhash64("id").alias("k"), "h").join(result, key).select(F.col("id").alias(id_col), *result.columns[2:])


def _third(n: Column) -> Column:
    return F.floor(n / 3).cast("int")


def op2_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of documents.

    Null text is empty: one empty paragraph. Null ids come last in the order, rows of one id follow each
    other by descending text hash, repeated rows count once and all get that result; a table of one row
    is its own next. An empty table gives no rows; other columns are ignored.
    """
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
