"""Quality by compression: zstandard dictionaries of good and bad text, and calibrated size differences.

Two dictionaries of one size are trained on a bounded, documented sample of labelled texts (SAMPLE a
class, least hashes of the id first), one on good and one on bad ones; the size is what the class with
less text supports. Of a text, BLOCKS blocks spread evenly over its whole length teach at most; a line
teaches once, and nothing if both classes have it, or a shared passage would count for one class. A
text is compressed in blocks of BLOCK bytes with either dictionary, so that the dictionary and not the
text itself explains each block. Its score grows with the normalised difference (bad - good) / (raw
size + PLAIN).

Text of one repeated word has next to no difference, as either dictionary leaves next to nothing of it.
So there is a second input: by how much a text shrinks below all but a part USUAL of the good ones, on a
log scale, and 0 if it doesn't. A logistic fit with weights that can't be negative makes a probability of the two, on
the sampled whole texts, each measured by dictionaries that it did not train (FOLD_PAIRS pairs),
weighted to the true numbers of the classes. Scoring reads whole texts, row by row, without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS = 5
THRESHOLD = 0.3
SAMPLE = 2400
BLOCK = 256
BLOCKS = 32
PLAIN = 64
DICTIONARY = 112_000
FOLD_PAIRS = 4
HOLD = 0.05
USUAL = 0.02
LEVEL = 3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(blocks: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(blocks)[:size]


def _pair(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Dictionaries of one size for both classes' blocks: half the text of the smaller class, DICTIONARY at most."""
    size = min(DICTIONARY, min(sum(map(len, good)), sum(map(len, bad))) // 2)
    return _dictionary(good, max(size, BLOCK)), _dictionary(bad, max(size, BLOCK))


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(data) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain)


def measured(by_good: zstandard.ZstdCompressor, by_bad: zstandard.ZstdCompressor, data: bytes) -> tuple[float, float]:
    """(difference, shrinkage): the normalised difference, and the log of the larger size to the raw one."""
    g = b = 0
    for block in _blocks(data):
        g += len(by_good.compress(block))
        b += len(by_bad.compress(block))
    shrunk = math.log(max(1, g, b) / max(1, len(data)))  # by both, as a text that one dictionary holds shrinks too
    return (b - g) / (len(data) + PLAIN), min(1.0, max(-4.0, shrunk))


class Model:
    """Dictionaries and calibration; score() gives a text's probability of being good."""

    def __init__(self, good: bytes, bad: bytes, weights: tuple[float, float] = (0.0, 0.0), base: float = 0.0, usual: float = 0.0):
        self.good, self.bad, self.weights, self.base, self.usual = good, bad, weights, base, usual
        self._with = None

    def __getstate__(self):
        return {**self.__dict__, "_with": None}

    def score(self, data: bytes) -> float:
        if self._with is None:
            self._with = _compressor(self.good), _compressor(self.bad)
        apart, shrunk = measured(*self._with, data)
        z = self.base + self.weights[0] * apart + self.weights[1] * min(0.0, shrunk - self.usual)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], float]:
    """Weights (0 or more) and base of a weighted logistic fit by Newton's steps, held towards 0 by HOLD."""
    mean, scale, w = x.mean(axis=0), x.std(axis=0) + 1e-9, w / w.mean()
    used = list(range(x.shape[1]))
    while True:
        a = np.column_stack(((x[:, used] - mean[used]) / scale[used], np.ones(len(x))))
        at, hold = np.zeros(a.shape[1]), np.array([HOLD] * len(used) + [1e-3])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a @ at, -35, 35)))
            bend = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(hold)
            step = np.clip(np.linalg.solve(bend, a.T @ (w * (y - p)) - hold * at), -3, 3)  # cut where the fit is near separable
            at = at + step
            if np.abs(step).max() < 1e-8:
                break
        if not used or at[:-1].min() >= 0:
            break
        used.pop(int(np.argmin(at[:-1])))
    weights = np.zeros(x.shape[1])
    weights[used] = at[:-1] / scale[used]
    return weights.tolist(), float(at[-1] - weights @ mean)


def _sample(docs: DataFrame, labels: DataFrame, folds: int, sample: int, id_col: str, text_col: str) -> tuple[dict[int, int], DataFrame]:
    """The numbers of labelled rows by class, and (y, k, id, t): the sampled texts and which pair of dictionaries leaves each out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & (common.fold(id_col, folds) != 0))
    known = known.select(F.col(id_col).alias("id"), F.col("quality").alias("y"))
    number = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("id"), F.col("id"))
    chosen = known.where("y = 0").orderBy(*order).limit(sample).unionByName(known.where("y = 1").orderBy(*order).limit(sample))
    chosen = chosen.distinct().withColumn("k", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(FOLD_PAIRS)))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    drawn = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id", "y"])  # chosen: 2 * SAMPLE ids at most
    return number, common.written(drawn.select("y", "k", "id", "t"))


def _lessons(drawn: DataFrame) -> DataFrame:
    """(y, k, block): blocks of the sampled texts; repeated lines count once, and not at all if both classes have them."""
    lines = drawn.select("y", "k", "id", F.posexplode(F.split("t", "\n", -1)).alias("at", "line"))
    once = lines.groupBy(F.xxhash64("line")).agg(F.min(F.struct("y", "id", "at", "k", "line")).alias("one"), F.max("y").alias("z")).where("one.y = z").select("one.*")
    own = once.groupBy("y", "k", "id").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("l"))  # of one text
    text = own.select("y", "k", "id", F.array_join("l.line", "\n").cast("binary").alias("t"))

    def cut(batches):
        for b in batches:
            for y, k, _, t in zip(*b.columns):
                blocks = _blocks(t.as_py())
                few = [blocks[i * len(blocks) // BLOCKS] for i in range(BLOCKS)] if len(blocks) > BLOCKS else blocks
                yield pa.RecordBatch.from_arrays([
                    pa.array([y.as_py()] * len(few), pa.int32()), pa.array([k.as_py()] * len(few), pa.int64()), pa.array(few, pa.binary())
                ], names=["y", "k", "block"])

    return text.mapInArrow(cut, "y int, k long, block binary")


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled rows outside fold 0; null ids, labels and texts and other labels than 0 and 1 teach nothing.

    Of rows that share an id one text teaches. Without labelled text of both classes every score is the
    part of good labels (0.5 without any).
    """
    number, drawn = _sample(docs, labels, folds, sample, id_col, text_col)
    got: dict[tuple[int, int], list[bytes]] = {}
    for r in sorted(_lessons(drawn).collect(), key=lambda r: (r.y, r.k, bytes(r.block))):  # BLOCKS * BLOCK bytes a sampled text at most
        got.setdefault((r.y, r.k), []).append(bytes(r.block))
    taught = lambda y, but=None: [b for (c, k), bs in got.items() if c == y and k != but for b in bs]
    if not taught(0) or not taught(1):
        common.discard(drawn)
        part = number.get(1, 0) / max(1, sum(number.values())) if number else 0.5
        part = min(max(part, 1e-6), 1 - 1e-6)
        return Model(b"", b"", base=math.log(part / (1 - part)))
    model = Model(*_pair(taught(1), taught(0)))
    pairs = {k: _pair(taught(1, k), taught(0, k)) if taught(0, k) and taught(1, k) else (model.good, model.bad) for k in range(FOLD_PAIRS)}
    held = drawn.sparkSession.sparkContext.broadcast(pairs)  # FOLD_PAIRS * 2 * DICTIONARY bytes at most

    def measure(batches):
        by = {k: tuple(map(_compressor, p)) for k, p in held.value.items()}
        for b in batches:
            rows = [measured(*by[k.as_py()], t.as_py()) for k, t in zip(b.column(1), b.column(2))]
            x = np.array(rows, float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "apart", "shrunk"])

    src = drawn.select(F.col("y").cast("int").alias("y"), "k", F.col("t").cast("binary").alias("t"))
    rows = sorted(tuple(r) for r in src.mapInArrow(measure, "y int, apart double, shrunk double").collect())  # a row for each sampled text
    common.discard(drawn)
    y, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    model.usual = float(np.quantile(x[y == 1, 1], USUAL))
    weight = {c: number[c] / (y == c).sum() for c in (0, 1)}
    x[:, 1] = np.minimum(0, x[:, 1] - model.usual)
    model.weights, model.base = calibrated(x, y, np.array([weight[c] for c in y]))
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a score column (double); null text is scored as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes at most

    @F.pandas_udf("double")
    def score(t):
        m = held.value
        return t.map(lambda b: m.score(bytes(b)))

    return docs.withColumn("score", score(common.text_of(text_col).cast("binary")))


def classify(
    docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: id_col, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Repeated rows stay; only id and text are read, the id for its fold alone.
    """
    model = fit(docs, labels, folds, id_col=id_col, text_col=text_col)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return scored(src, model, "id", "t").select(
        F.col("id").alias(id_col), (common.fold("id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    Null text is scored as empty, which has neither difference nor shrinkage and so the base score;
    equal texts have equal scores; a null id is in no held-out fold but that of the empty text; repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
