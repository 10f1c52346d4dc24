"""Packing documents into near-equal windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one end id. What fills whole windows is cut off first and needs no
partner; the rest of a document, or a short document, is one item. Each partition packs its items in
batches of a fixed number of windows: every item starts as a partial partition of the batch into windows
(itself and empty ones), and the two partial partitions of widest spread merge, the fullest windows of
one meeting the emptiest of the other, until one partition is left. Partial partitions are held without
their empty windows, and documents under LEAST tokens join the next ones to an item of that size, so a
batch of the smallest documents is a few thousand items. While a window passes the capacity, the batch
is parted again into one window more, up to SPARE more; more would be padding, and what then still
passes the capacity is cut off and goes to the emptiest windows. So most documents stay in one piece.
The tokens that fill no window at a partition's end become windows of power-of-two length.

No token is shuffled: a partition reads, encodes, cuts and packs in one pass, holding one batch.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END = 1
WINDOWS = 256
LEAST = 64  # tokens of an item
SPARE = 1 / 128  # part of a batch's windows by which their number may rise


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, by Karmarkar-Karp differencing into that many windows.

    A partial partition is its loads in falling order without those at the end that are its least, which
    count as 0: an item alone is one number, whatever the number of windows.
    """
    if not sizes:
        return np.zeros(0, np.int64)
    loads: list[np.ndarray | None] = [np.array([s], np.int64) for s in sizes]
    heap, merges = [(-s if windows > 1 else 0, i) for i, s in enumerate(sizes)], []
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = loads[a], loads[b]
        loads[a] = loads[b] = None
        if len(x) + len(y) <= windows:  # no window of one meets one of the other
            order = np.argsort(-np.concatenate((x, y)), kind="stable")
            total, merged = np.concatenate((x, y))[order], (a, b, len(x), order.astype(np.int32), False)
        else:
            total = np.zeros(windows, np.int64)
            total[: len(x)] = x
            total[windows - len(y) :] += y[::-1]
            order = np.argsort(-total, kind="stable")
            total, merged = total[order], (a, b, len(x), order.astype(np.int32), True)
            total = total - total[-1]
            total = total[: max(1, np.count_nonzero(total))]
        merges.append(merged)
        loads.append(total)
        heapq.heappush(heap, (-int(total[0]) if windows > 1 and len(total) < windows else int(total[-1] - total[0]), len(loads) - 1))
    # From the last merge back: which window each place of a partial partition is. Places that it does not
    # hold are empty ones, in any order: all windows that its places don't name.
    of, top = np.zeros(len(sizes), np.int64), {len(loads) - 1: np.arange(windows, dtype=np.int32)}

    def put(part: int, places: np.ndarray) -> None:
        if part < len(sizes):
            of[part] = places[0]
        else:
            top[part] = places

    for k in range(len(merges) - 1, -1, -1):
        a, b, n, order, full = merges[k]
        given = top.pop(len(sizes) + k)
        mine = np.empty(len(order), np.int32)
        mine[order] = given[: len(order)]
        if full:
            put(a, mine)
            put(b, mine[::-1])
        else:
            put(a, np.concatenate((mine, given[len(order) :])))
            put(b, np.concatenate((mine[n:], mine[:n], given[len(order) :])))
    return of


def balanced(sizes: list[int], windows: int, capacity: int) -> tuple[np.ndarray, int]:
    """differencing() into windows; while one passes the capacity, into one more, up to SPARE more (one at least). And their number."""
    most = windows + max(1, int(windows * SPARE))
    while True:
        of = differencing(sizes, windows)
        if windows == most or np.bincount(of, sizes, minlength=1).max(initial=0) <= capacity:
            return of, windows
        windows += 1


Piece = tuple[int, int, int]


def within_capacity(into: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """The windows' pieces (document, start, length), with what passes the capacity cut off and put where most room is."""
    loose, room = [], []
    for w, pieces in enumerate(into):
        over = sum(n for _, _, n in pieces) - capacity
        while over > 0:
            k = max(range(len(pieces)), key=lambda i: pieces[i][2])
            doc, s, n = pieces[k]
            take = min(n, over)
            loose.append((doc, s + n - take, take))
            pieces[k : k + 1] = [(doc, s, n - take)] if take < n else []
            over -= take
        if over < 0:
            room.append((over, w))
    heapq.heapify(room)
    for doc, s, n in sorted(loose, key=lambda p: (-p[2], p)):
        while n:
            free, w = heapq.heappop(room)
            take = min(n, -free)
            into[w].append((doc, s, take))
            s, n = s + take, n - take
            if take < -free:
                heapq.heappush(room, (free + take, w))
    return into


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class _Packer:
    """Packs the pieces of one partition; rows are (document's row, start, length, sequence, offset)."""

    def __init__(self, capacity: int, windows: int, first: int):
        self.capacity, self.next, self.fill = capacity, first, windows * capacity
        self.wait, self.held, self.rows = [], 0, []  # wait: items, each of pieces of whole documents
        self.small: list[Piece] = []

    def add(self, doc: int, n: int) -> None:
        full = n // self.capacity * self.capacity
        for s in range(0, full, self.capacity):
            self.put([(doc, s, self.capacity)])
        if full < n:
            if self.held + n - full > self.fill:
                self.flush()
            self.held += n - full
            if n - full >= LEAST:
                self.wait.append([(doc, full, n - full)])
                return
            self.small.append((doc, full, n - full))
            if sum(p[2] for p in self.small) >= LEAST:
                self.bundle()

    def bundle(self) -> None:
        """Documents too small for an item of their own as one."""
        if self.small:
            self.wait.append(self.small)
            self.small = []

    def waiting(self) -> set[int]:
        return {p[0] for item in [*self.wait, self.small] for p in item}

    def put(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for doc, s, n in pieces:
            self.rows.append((doc, s, n, self.next, at))
            at += n
        self.next += 1

    def flush(self) -> None:
        self.bundle()
        if not self.wait:
            return
        sizes = [sum(p[2] for p in item) for item in self.wait]
        of, windows = balanced(sizes, max(1, -(-self.held // self.capacity)), self.capacity)
        into: list[list[Piece]] = [[] for _ in range(windows)]
        for item, w in zip(self.wait, of.tolist()):
            into[w] += item
        for pieces in within_capacity(into, self.capacity):
            if pieces:
                self.put(pieces)
        self.wait, self.held = [], 0

    def close(self) -> None:
        """What is left: full windows as before, then windows of power-of-two length."""
        self.bundle()
        over = self.held % self.capacity
        tail = []
        while over and self.wait:
            item = self.wait[-1]
            doc, s, n = item.pop()
            take = min(n, over)
            if take < n:
                item.append((doc, s, n - take))
            if not item:
                self.wait.pop()
            tail.append((doc, s + n - take, take))
            over -= take
            self.held -= take
        self.flush()
        tail.reverse()
        for size in powers(sum(n for _, _, n in tail)):
            window = []
            while size:
                doc, s, n = tail.pop(0)
                take = min(n, size)
                if take < n:
                    tail.insert(0, (doc, s + take, n - take))
                window.append((doc, s, take))
                size -= take
            self.put(window)


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int | None = END, windows: int = WINDOWS,
    with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if with_ids.

    Null text counts as empty, so only its end id is packed; with end=None an empty text has no row.
    Repeated rows are packed each; items of one size keep the order of their rows, so ties need no other
    rule; an empty table gives no rows; other columns are ignored. sequence_id holds the partition's number
    in its upper bits: it is unique and gapless only within a partition.
    """
    src = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("t"))
    kind = dict(src.dtypes)["id"]
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        encode = bpe.encoder(tokenizer_path)
        packer = _Packer(capacity, windows, TaskContext.get().partitionId() << 32)
        known: dict[int, tuple] = {}  # rows with a piece that waits
        n = 0

        def out(doc_type):
            rows, packer.rows = packer.rows, []
            data = [known[r[0]][1][r[1] : r[1] + r[2]] for r in rows]
            cols = [
                pa.array([known[r[0]][0] for r in rows], doc_type),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in data], pa.int64()),
                pa.array([len(known[r[0]][1]) for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
            ]
            if with_ids:
                cols.append(pa.array([d.astype(np.int64) for d in data], pa.list_(pa.int64())))
            waits = packer.waiting()
            for k in [k for k in known if k not in waits]:
                del known[k]
            return pa.RecordBatch.from_arrays(cols, names=["id", *names, *["ids"] * with_ids])

        kind_of = None
        for b in batches:
            kind_of = b.column(0).type
            for i, t in zip(b.column(0), b.column(1)):
                ids = encode(t.as_py())
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                known[n] = (i.as_py(), ids)
                packer.add(n, len(ids))
                n += 1
                if len(packer.rows) >= 4096:
                    yield out(kind_of)
        packer.close()
        if packer.rows:
            yield out(kind_of)

    schema = f"id {kind}, " + ", ".join(f"{x} long" for x in names) + ", ids array<long>" * with_ids
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty: its end id alone is packed. Repeated rows are packed each, items of one size in
    the order of their rows; an empty table gives no rows; other columns are ignored.
    """
    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)
