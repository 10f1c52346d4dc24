"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

The model holds each language's log-likelihoods of hashed letter trigrams, learnt from a bounded,
documented sample of labelled texts (SAMPLE a language on average, whole texts), for every language
that has labels. A whole text is cut into segments of SEGMENT trigrams; expectation-maximisation finds
the proportions of languages that make its segments likeliest. The set of languages minimises the
penalised likelihood, -2 log-likelihood + PENALTY log segments for every further language: from the
likeliest single one it grows by the language along which the likelihood rises most, and then loses
those of least proportion, as long as that lowers the cost. As the likelihood is concave in the
proportions, that rise bounds what a language can bring, so most texts end with their first one. All
texts of an Arrow batch are worked out together; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD = 4, 2
BUCKETS = 1 << 16
SEGMENT = 24
SAMPLE = 2000
ROUNDS, STILL = 200, 1e-3
DENSE = 64
PENALTY = 8.0
SHARPNESS = 20.0
SMOOTHING = 0.5
_CHUNK = 1 << 19
_LETTER: list[np.ndarray] = []


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0][codes]


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams around every letter, lower-cased, other characters as blanks."""
    low = f" {text.lower()} "
    parts = [_hashed(low[i : i + _CHUNK + 2]) for i in range(0, max(1, len(low) - 2), _CHUNK)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _hashed(low: str) -> np.ndarray:
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(c)
    if not letter[1:-1].any():
        return np.zeros(0, np.uint16)
    c = np.where(letter, c, 32).astype(np.uint64)
    g = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
    return g[letter[1:-1]].astype(np.uint16)

CELLS = 1 << 20  # likelihoods held at once


class Model:
    """languages; log-likelihoods by bucket and language; the least mean log-likelihood a trigram of each language's texts.

    Counts are held by bucket as found (start, language, gain over a trigram never seen), so that many
    languages take no more room than the trigrams they have; up to DENSE languages also as a table.
    """

    def __init__(self, languages: list[str], buckets: np.ndarray, of: np.ndarray, counts: np.ndarray):
        self.languages, n = languages, len(languages)
        total = np.bincount(of, counts, minlength=n)
        self.never = np.log(SMOOTHING / (total + SMOOTHING * BUCKETS))
        order = np.argsort(buckets, kind="stable")
        self.start = np.searchsorted(buckets[order], np.arange(BUCKETS + 1))
        self.of = of[order].astype(np.int32)
        self.gain = np.log1p(counts[order] / SMOOTHING)
        rest = np.maximum(total - 1, 0) + SMOOTHING * BUCKETS  # of a language's own trigrams, each left out in turn
        own = np.bincount(of, counts * np.log(np.maximum(counts - 1, 0) + SMOOTHING), minlength=n) / np.maximum(total, 1) - np.log(rest)
        self.least = np.where(total > 0, (own + self.never) / 2, np.inf)  # halfway between its own trigrams and those it never had
        self.table = None
        if n <= DENSE:
            self.table = np.repeat(self.never[None], BUCKETS, axis=0).astype(np.float32)
            self.table[buckets[order], self.of] += self.gain

    def segments(self, text: str) -> tuple[np.ndarray, int]:
        """Log-likelihoods by segment and language, and the number of trigrams."""
        g = trigrams(text)
        parts, step, n = [], _CHUNK // SEGMENT * SEGMENT, len(self.languages)
        for i in range(0, len(g), step):
            part = g[i : i + step]
            cuts = np.arange(0, len(part), SEGMENT)
            if self.table is not None:
                parts.append(np.add.reduceat(self.table[part], cuts, axis=0, dtype=np.float64))
                continue
            for j in range(0, len(cuts), 1024):
                some = part[j * SEGMENT : (j + 1024) * SEGMENT]
                first = self.start[some]
                many = self.start[some + np.int32(1)] - first
                at = np.repeat(first - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
                row = np.repeat(np.arange(len(some)) // SEGMENT, many)
                rows = -(-len(some) // SEGMENT)
                gains = np.bincount(row * n + self.of[at], self.gain[at], minlength=rows * n).reshape(rows, n)
                length = np.bincount(np.arange(len(some)) // SEGMENT)
                parts.append(gains + length[:, None] * self.never)
        return (np.concatenate(parts) if parts else np.zeros((0, n))), len(g)

    def surplus(self, text: str, chosen: list[str]) -> float | None:
        """By how much a trigram is likelier than the limit, each segment under that of the chosen languages which explains it best.

        None without letters or chosen languages. At least 0: text of those languages, however many they are.
        """
        segs, n = self.segments(text)
        if not segs.size or not chosen:
            return None
        at = [self.languages.index(k) for k in chosen]
        length = np.full(len(segs), SEGMENT)
        length[-1] = n - SEGMENT * (len(segs) - 1)
        return float((segs[:, at] - length[:, None] * self.least[at]).max(axis=1).sum() / n)

    def mixtures(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """For each text the language, its score, and the set kept with proportions; und, 0, [] without letters.

        The score is the language's proportion times how clearly its mean likelihood leads.
        """
        none = ("und", 0.0, [])
        if not self.languages:
            return [none] * len(texts)
        segs = [self.segments(t)[0] for t in texts]
        at = [k for k, s in enumerate(segs) if len(s)]
        out: list = [none] * len(texts)
        if not at:
            return out
        size = np.array([len(segs[k]) for k in at])
        ll = np.concatenate([segs[k] for k in at])
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(ll - top, -700))
        means = np.add.reduceat(ll, starts, axis=0) / size[:, None]
        kept = _chosen(like, size, means)
        clear = np.exp(SHARPNESS / SEGMENT * (means - means.max(axis=1, keepdims=True)))
        clear /= clear.sum(axis=1, keepdims=True)
        for n, k in enumerate(at):
            j = int(np.argmax(kept[n]))
            share = [(self.languages[i], float(kept[n, i])) for i in np.argsort(-kept[n], kind="stable") if kept[n, i] > 0]
            out[k] = (self.languages[j], float(min(1.0, kept[n, j] * max(clear[n, j], 1 / len(self.languages)))), share)
        return out


def _em(like: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text: proportions of the allowed languages, log-likelihood (to a constant of the text), its rise along each language."""
    starts, doc = np.concatenate(([0], np.cumsum(size)[:-1])), np.repeat(np.arange(len(size)), size)
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    moving = allowed.sum(axis=1) > 1
    live, own, of = np.flatnonzero(moving), like[moving[doc]], np.repeat(np.arange(moving.sum()), size[moving])
    for _ in range(ROUNDS):
        if not len(live):
            break
        now, n = pi[live], size[live]
        r = own * now[of]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        pi[live] = np.add.reduceat(r, np.concatenate(([0], np.cumsum(n)[:-1])), axis=0) / n[:, None]
        moving = np.abs(pi[live] - now).max(axis=1) >= STILL  # each text stops by itself, whatever it is dealt with
        if not moving.all():
            own, live = own[moving[of]], live[moving]
            of = np.repeat(np.arange(len(live)), size[live])
    mix = np.maximum((like * pi[doc]).sum(axis=1), 1e-300)
    rise = np.add.reduceat(like / mix[:, None], starts, axis=0) - size[:, None]
    return pi, np.add.reduceat(np.log(mix), starts), rise


def _chosen(like: np.ndarray, size: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Proportions by text of the set of least penalised likelihood; the segments of like are the texts', one after the other."""
    one = np.zeros(means.shape, bool)
    one[np.arange(len(size)), np.argmax(means, axis=1)] = True
    pi, fit, rise = _em(like, size, one)
    price = PENALTY * np.log(size + 1)
    cost = -2 * fit

    def attempt(at: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Take the sets of texts at where they cost less; which did."""
        rows = np.repeat(np.isin(np.arange(len(size)), at), size)
        p, f, up = _em(like[rows], size[at], allowed)
        c = -2 * f + price[at] * (allowed.sum(axis=1) - 1)
        better = c < cost[at] - 1e-9
        where = at[better]
        one[where], pi[where], rise[where], cost[where] = allowed[better], p[better], up[better], c[better]
        return where

    at = np.arange(len(size))
    while len(at):  # grow
        best = np.argmax(np.where(one[at], -np.inf, rise[at]), axis=1)
        hope = ~one[at].all(axis=1) & (2 * rise[at, best] > price[at])
        at, best = at[hope], best[hope]
        more = one[at].copy()
        more[np.arange(len(at)), best] = True
        at = attempt(at, more) if len(at) else at
    at = np.flatnonzero(one.sum(axis=1) > 1)
    while len(at):  # shrink
        less = one[at].copy()
        less[np.arange(len(at)), np.argmin(np.where(one[at], pi[at], np.inf), axis=1)] = False
        at = attempt(at, less)
        at = at[one[at].sum(axis=1) > 1]
    return pi


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows outside the held fold; null texts and languages teach nothing."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (common.fold(id_col, folds) != held))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    number = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    languages = sorted(r.lang for r in number)
    none = np.zeros(0, np.int64)
    if not number:
        return Model([], none, none, none)
    where = {name: i for i, name in enumerate(languages)}
    parts = docs.sparkSession.createDataFrame([(r.lang, where[r.lang], min(1.0, sample / r.n)) for r in number], "lang string, place int, part double")
    drawn = known.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < F.col("part") * 1_000_000)

    def summed(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n, pa.int64())], names=["key", "n"])

    def count(batches):
        held, size = [], 0
        for b in batches:
            for place, t in zip(b.column(0), b.column(1)):
                held.append(trigrams(t.as_py()) + np.int64(place.as_py() * BUCKETS))
                size += len(held[-1])
                if size >= 1 << 22:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    found = drawn.select("place", "t").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    return Model(languages, key % BUCKETS, key // BUCKETS, n)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", surplus: bool = False) -> DataFrame:
    """docs with lang_pred, score and mixture (array of language and proportion).

    surplus: also Model.surplus of the text under the languages of its mixture; null without letters.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # the trigrams that each language has, BUCKETS at most
    kind = "lang_pred string, score double, mixture array<struct<language:string,proportion:double>>" + (", surplus double" if surplus else "")

    @F.pandas_udf(kind)
    def guess(t):
        import pandas as pd

        texts, rows = list(t), []
        at, cells, wide = 0, 0, max(1, len(held.value.languages))
        for i, x in enumerate(texts, 1):  # so many texts at once that their segments by languages stay few
            cells += (len(x) // SEGMENT + 1) * wide
            if cells > CELLS or i == len(texts):
                rows += held.value.mixtures(texts[at:i])
                at, cells = i, 0
        out = pd.DataFrame({
            "lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows],
            "mixture": [[{"language": a, "proportion": p} for a, p in r[2]] for r in rows],
        })
        if surplus:
            over = [held.value.surplus(x, [k for k, _ in r[2]]) for x, r in zip(texts, rows)]
            out["surplus"] = pd.Series(over, dtype="float64")
        return out

    out = docs.withColumn("_guess", guess(common.text_of(text_col)))
    return out.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "mixture", "surplus")], "_guess.*")


def identify(docs: DataFrame, folds: int = FOLDS, held: int = HELD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, mixture.

    und and 0 for null texts and texts without a letter, and for all if nothing could be learnt. Ties go
    to the language of lower code points. Repeated rows stay; other columns are ignored.
    """
    model = fit(docs, folds, held, id_col=id_col, text_col=text_col, lang_col=lang_col)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return predicted(src, model, "id", "t").select(
        F.col("id").alias(id_col), (common.fold("id", folds) == held).alias("held_out"), "lang_pred", "score", "mixture"
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture for every row of documents.

    Null texts and texts without a letter are und with score 0; a tie goes to the language of lower code
    points, so equal texts have equal results; a null id is held out or not as the empty text; repeated
    rows stay; an empty table gives no rows; other columns are ignored.
    """
    return identify(common.table(spark, sf_dir, "documents"))
