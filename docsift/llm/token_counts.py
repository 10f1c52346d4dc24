"""Token counts through a digest cache.

Texts are keyed by the SHA-256 of their bytes (null as empty; any further normalisation would change
counts) and by a digest of all that defines the encoding. Distinct digests are held against the cache
before any text moves; of those that miss one text each is encoded, and the counts are appended. So with
a filled cache only digests are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

TOKENIZER = "byte_bpe_50k.json"
BROADCAST = 500_000  # digests of 32 bytes
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _encoded(misses: DataFrame, path: str, ver: str) -> DataFrame:
    """(digest, t) -> rows of the cache."""

    def run(batches):
        encode = bpe.encoder(path)
        for b in batches:
            n = pa.array([len(encode(t.as_py())) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ver] * len(n), pa.string()), n], names=["digest", "tokenizer", "n_tokens"])

    return misses.select("digest", "t").mapInArrow(run, CACHE_SCHEMA)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def cached(spark: SparkSession, cache_path: str, ver: str) -> DataFrame:
    """The cache's (digest, n_tokens) of one tokenizer version; no folder is an empty cache."""
    if not _exists(spark, cache_path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == ver)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have met one miss


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); repeated rows and copies are encoded once; other
    columns are ignored. cache_path: a Parquet folder that is read and appended to; None: a new one on
    shared storage.
    """
    spark = docs.sparkSession
    cache_path = cache_path or common.shared_dir(spark)
    ver = bpe.version(tokenizer_path)
    t = common.text_of(text_col)
    keyed = docs.select(
        F.col(id_col).alias("id"), F.octet_length(t).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), t.alias("t"),
    )
    if _exists(spark, cache_path):
        missed = common.written(keyed.select("digest").distinct().join(cached(spark, cache_path, ver), "digest", "left_anti"))
        few = missed.count() <= BROADCAST
        of_missed = keyed.join(F.broadcast(missed), "digest", "left_semi") if few else keyed
        texts = of_missed.groupBy("digest").agg(F.first("t").alias("t"))
        misses = texts if few else texts.join(missed, "digest", "left_semi")
    else:
        missed, misses = None, keyed.groupBy("digest").agg(F.first("t").alias("t"))
    _encoded(misses, tokenizer_path, ver).write.mode("append").parquet(cache_path)
    common.discard(missed)
    counts = common.written(cached(spark, cache_path, ver))  # a plain table: a join with it can split the rows of one text's copies
    return keyed.drop("t").join(counts, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents.

    Null text counts as empty: 0 bytes and 0 tokens. Repeated rows and copies stay and are encoded once;
    an empty table gives no rows; other columns are ignored.
    """
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), cache_path)
