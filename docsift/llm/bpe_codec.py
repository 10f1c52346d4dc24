"""Byte-pair encoding and decoding of texts, with the merge loop of our own.

A word's parts are held as two parallel arrays: the part boundaries, and the rank of each part joined
with its right neighbour. The array of ranks is scanned for its minimum, the boundary there is deleted,
and only the ranks beside it are looked up anew, until no two neighbours merge. That is quadratic, so it
is for short words, which nearly all are; a word of more than SHORT bytes keeps its pairs in a heap over
linked parts, with the same merges in the same order (least rank first, then leftmost).

What merges is read from the tokenizer's file: byte-level models of merges between ids, without dropout,
prefixes or unknown tokens; other files are refused. Texts are cut into words, found words are remembered
up to a bounded number, and a long text is read a stretch at a time. Spark spreads the rows; nothing is
shuffled, so a lost task is encoded again.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
SHORT = 128
REMEMBERED = 200_000  # words of SHORT bytes at most
STRETCH = 1 << 18  # characters
BATCH_BYTES = 16 << 20
#: Fixed value: the splitting pattern of byte-level models.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file; ids are uint32."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or odd:
            raise ValueError(f"{path}: not a plain byte-level model of merges {odd}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens that take their surroundings are not supported")
        letters, vocab = byte_letters(), model["vocab"]
        self.byte = [0] * 256
        for letter, b in letters.items():
            self.byte[b] = vocab[letter]
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}  # two ids -> rank of their merge, id of the result
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.joined.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in added if t["content"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.ends = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.known = _Known(self)

    def short(self, word: bytes) -> list[int]:
        """The ids of a word, by the contiguous array of ranks."""
        ids = [self.byte[b] for b in word]
        pairs = [self.joined.get(p, (NEVER, 0)) for p in zip(ids, ids[1:])]
        ranks, made = [r for r, _ in pairs], [i for _, i in pairs]
        look = self.joined.get
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            at = ranks.index(least)
            ids[at] = made[at]  # the boundary between at and at + 1 goes
            del ids[at + 1], ranks[at], made[at]
            if at < len(ranks):
                ranks[at], made[at] = look((ids[at], ids[at + 1]), (NEVER, 0))
            if at:
                ranks[at - 1], made[at - 1] = look((ids[at - 1], ids[at]), (NEVER, 0))
        return ids

    def long(self, word: bytes) -> list[int]:
        """The same ids in n log n: pairs in a heap, parts linked to their neighbours."""
        ids = [self.byte[b] for b in word]
        n = len(ids)
        after, before, look = [*range(1, n), -1], list(range(-1, n - 1)), self.joined.get
        heap = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := look((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue  # one of the two has merged otherwise since
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and (hit := look((ids[x], ids[y]))):
                    heapq.heappush(heap, (hit[0], x, hit[1], ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def _stretches(self, text: str, at: int, end: int) -> Iterator[tuple[int, int]]:
        """Parts of text[at:end] that split into words as the whole does: cut before a lone space between non-spaces."""
        while end - at > STRETCH:
            hit = self.cut.search(text, at + STRETCH, end)
            if not hit:
                break
            yield at, hit.start()
            at = hit.start()
        yield at, end

    def _plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        of = self.known.__getitem__
        for a, b in self._stretches(text, at, end):
            yield from map(of, self.words.findall(text, a, b))

    def _parts(self, text: str) -> Iterator[bytes]:
        at = 0
        for hit in self.ends.finditer(text) if self.ends else ():
            yield from self._plain(text, at, hit.start())
            yield np.uint32(self.special[hit.group()]).tobytes()
            at = hit.end()
        yield from self._plain(text, at, len(text))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; strings of added tokens become those tokens."""
        return b"".join(self._parts(text))

    def decode(self, ids: bytes) -> str:
        """The text of ids from encode(), added tokens included; bytes that are no UTF-8 become U+FFFD, ids without a token nothing."""
        utf8, of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        found = np.frombuffer(ids, "<u4")
        out = [utf8.decode(b"".join([of.get(i, b"") for i in found[k : k + STRETCH].tolist()])) for k in range(0, len(found), STRETCH)]
        return "".join([*out, utf8.decode(b"", True)])


class _Known(dict):
    """word -> its ids' bytes, computed when first asked for; forgotten together when there are too many."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = np.array(self.codec.short(raw) if len(raw) <= SHORT else self.codec.long(raw), "<u4").tobytes()
        if len(raw) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, col: str, out: str, kind: str, work) -> DataFrame:
    """df with out, work() of each value of col (null: null), in Arrow batches of bounded bytes."""
    if out in df.columns:
        raise ValueError(f"{out} is a column already")
    names = df.columns

    def run(batches):
        do = work()
        arrow = pa.binary() if kind == "binary" else pa.string()
        for b in batches:
            at, held, size = 0, [], 0
            for i, v in enumerate(chain(b.column(names.index(col)), [None])):
                if i == b.num_rows or size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([*b.slice(at, i - at).columns, pa.array(held, arrow)], names=[*names, out])
                    at, held, size = i, [], 0
                if i < b.num_rows:
                    x = v.as_py()
                    held.append(x if x is None else do(x))
                    size += len(held[-1] or "") + len(x or "")

    return df.mapInArrow(run, f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out}` {kind}")


def encoded(df: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text, as little-endian unsigned 32-bit integers in a binary; null: null."""
    return _mapped(df, text_col, out, "binary", lambda: codec(tokenizer_path).encode)


def decoded(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text of each binary of ids; null: null."""
    return _mapped(df, ids_col, out, "string", lambda: codec(tokenizer_path).decode)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of documents.

    Null text is empty: 0 tokens and digests of nothing. Repeated rows and null ids stay; an empty table
    gives no rows; other columns are ignored. Texts of any length are encoded whole.
    """
    path = public_tokenizers.path(TOKENIZER)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_of("text").alias("text"))
    out = decoded(encoded(docs, path).drop("text"), path)
    return out.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
