"""Files as rows, rule files, result writers and the alert store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_RULES = "rule_id bigint, rule_type int, rule_content string, rule_desc string"


def collect_files(spark: SparkSession, folder: str, recursive: bool = True, most_bytes: int | None = None, glob: str | None = None) -> DataFrame:
    """(path, name, ext, size, modificationTime, content) of a folder's files.

    Spark's listing leaves out files and folders that start with . or _. The size bound is pushed down
    to the listing, so large files are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    if most_bytes is not None:
        df = df.where(F.col("length") <= most_bytes)
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumn("name", name).select("path", "name", F.lower(F.regexp_extract("name", r"\.([^.]*)\z", 1)).alias("ext"), F.col("length").alias("size"), "modificationTime", "content")


def read_problem(size: Column, most_bytes: int) -> Column:
    """Why a file is not read: empty or too large; null if it is."""
    return F.when(size <= 0, "empty file").when(size > most_bytes, "file too large")


def head(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def of_categories(df: DataFrame, category: Column, wanted: list[str]) -> DataFrame:
    """Rows of the wanted categories; all if none is named."""
    return df.where(category.isin(*wanted)) if wanted else df


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_rules(spark: SparkSession, path: str, schema: str = HASH_RULES) -> DataFrame:
    """Rules of a JSON file, {"rules": [...]} or a bare list, with ord, their place in it; none if the file is missing."""
    row = T.StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*row.fields, T.StructField("ord", T.IntegerType())]))
    text = spark.read.option("wholetext", "true").text(path)
    many, wrapped = T.ArrayType(row), T.StructType([T.StructField("rules", T.ArrayType(row))])
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    rules = F.when(bare, F.from_json("value", many)).otherwise(F.from_json("value", wrapped).getField("rules"))
    return text.select(F.posexplode(rules).alias("ord", "r")).select("r.*", "ord")


def policy(spark: SparkSession, root: str, module: str, schema: str = HASH_RULES) -> DataFrame:
    """The rules of <root>/<module>/policy.json; a missing policy has none."""
    return read_rules(spark, f"{root}/{module}/policy.json", schema)


def single_hash_rule(spark: SparkSession, digest: str, rule_id: int = 1) -> DataFrame:
    """One MD5 rule (SM3 for 64 digits), its digest lower-cased."""
    d = digest.strip().lower()
    return spark.createDataFrame([(rule_id, int(len(d) == 64), d, "command line rule", 0)], f"{HASH_RULES}, ord int")


def rule_bytes(text: Column) -> Column:
    """Bytes of a rule given in hexadecimal digits or else base64."""
    return F.when(text.rlike(r"^(?:[0-9A-Fa-f]{2})+\z"), F.unhex(text)).otherwise(F.unbase64(text))


def write_results(df: DataFrame, path: str, form: str) -> None:
    """Results as json, csv (arrays joined by |, everything quoted) or text (tab-separated lines)."""
    flat = df.select(*[F.array_join(F.transform(F.col(n), lambda x: x.cast("string")), "|").alias(n) if k.startswith("array") else F.col(n).cast("string").alias(n) if form == "text" else F.col(n) for n, k in df.dtypes])
    if form == "json":
        df.write.json(path)
    elif form == "csv":
        flat.write.option("header", "true").option("quoteAll", "true").csv(path)
    elif form == "text":
        flat.select(F.concat_ws("\t", *flat.columns).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown form {form}")


class Store:
    """An append-only table of records in shared storage, as encrypted JSON rows: push, then pop all.

    Rows that the key doesn't open are skipped when popped. No order is promised.
    """

    def __init__(self, spark: SparkSession, path: str, key: bytes):
        if len(key) not in (16, 24, 32):
            raise ValueError("a key has 16, 24 or 32 bytes")
        self.spark, self.path, self.key = spark, path, key

    def push(self, df: DataFrame) -> None:
        data = F.aes_encrypt(F.to_json(F.struct(*df.columns)).cast("binary"), F.lit(self.key))
        df.select(F.expr("uuid()").alias("id"), data.alias("data"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(self.path)

    def pop_all(self, schema: str) -> DataFrame:
        """The records; the caller deletes the folder once they are delivered (clear)."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.parquet(self.path).select(F.try_aes_decrypt("data", F.lit(self.key)).cast("string").alias("j")).where("j is not null")
        return rows.select(F.from_json("j", schema).alias("r")).select("r.*")

    def clear(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
