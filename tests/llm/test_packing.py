import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from docsift.llm import bpe, packing

PATH = public_tokenizers.path(packing.TOKENIZER)
SCHEMA = "doc_id long, text string, start string, extra int"


def docs(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], SCHEMA).repartition(parts)


def test_every_id_once_and_windows_full(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|> inside", "é" * 30000] + [
        " ".join(rng.choice(["alpha", "beta", "12", "ünï"]) for _ in range(int(rng.lognormvariate(5, 1.2)))) for _ in range(400)
    ]
    texts += texts[-5:]
    got = packing.pack(docs(spark, texts), PATH).collect()
    slow = Tokenizer.from_file(PATH)
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, packing.END] for i, t in enumerate(texts)}
    pieces, seqs = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert {i: sum((p[1] for p in sorted(ps)), []) for i, ps in pieces.items()} == ids
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= packing.CAPACITY
    sizes = [sum(n for _, n in s) for s in seqs.values()]
    padding = sum(packing.CAPACITY - n for n in sizes if n & (n - 1))
    assert padding <= 0.03 * sum(sizes)


def test_empty_table_and_no_end_id(spark):
    assert packing.pack(docs(spark, []), PATH).count() == 0
    assert packing.pack(docs(spark, ["", None, "a b"]), PATH, end=None).count() == 1


@pytest.mark.parametrize("windows", [1, 2, 5])
def test_differencing_is_near_equal(windows):
    rng = random.Random(windows)
    sizes = [rng.randrange(1, 300) for _ in range(200)]
    loads = np.bincount(packing.differencing(sizes, windows), sizes)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= 3


def test_window_count_rises_beyond_capacity():
    of, windows = packing.balanced([60, 60, 60], 2, 100)
    assert windows == 3 and np.bincount(of, [60, 60, 60]).max() <= 100 and len(set(of.tolist())) == 3


def test_what_passes_the_capacity_is_cut_off():
    rng = random.Random(4)
    for _ in range(50):
        into = [[(10 * w + k, 0, rng.randrange(1, 90)) for k in range(rng.randrange(0, 4))] for w in range(8)]
        whole = {d: n for ps in into for d, _, n in ps}
        into += [[] for _ in range(max(0, -(-sum(whole.values()) // 100) - len(into)))]
        got = packing.within_capacity([list(p) for p in into], 100)
        assert all(sum(n for *_, n in ps) <= 100 for ps in got)
        parts = {}
        for d, s, n in (p for ps in got for p in ps):
            parts.setdefault(d, []).append((s, n))
        for d, n in whole.items():
            at = 0
            for s, m in sorted(parts[d]):
                assert s == at and m > 0
                at += m
            assert at == n


def test_given_documents_stay_whole_with_little_padding(spark):
    got = packing.op3_packing(spark, "/root/testdata/sf0.01")
    short = got.where("doc_tokens <= 2048").groupBy("doc_id").count().agg({"count": "avg"}).first()[0]
    sizes = [r[0] for r in got.groupBy("sequence_id").agg({"length": "sum"}).select("sum(length)").collect()]
    padding = sum(packing.CAPACITY - n for n in sizes if n & (n - 1))
    assert short <= 1.3 and padding <= 0.01 * sum(sizes)


def test_encoder_gives_the_librarys_ids():
    slow, fast = Tokenizer.from_file(PATH), bpe.encoder(PATH)
    rng = random.Random(9)
    pool = [chr(c) for c in range(0x250)] + ["　", " ", "😀", "中", "́", "<|endoftext|>", "'s", "  ", "\r\n"]
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(80)))
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def spread(sizes, windows):
    """The least possible greatest load, over all ways."""
    best, loads = [sum(sizes)], [0] * windows

    def deal(i):
        if max(loads) >= best[0]:
            return
        if i == len(sizes):
            best[0] = max(loads)
            return
        for w in range(min(windows, i + 1)):
            loads[w] += sizes[i]
            deal(i + 1)
            loads[w] -= sizes[i]

    deal(0)
    return best[0]


def test_differencing_against_the_best_of_all_ways():
    rng = random.Random(4)
    for _ in range(60):
        windows, sizes = rng.randrange(2, 5), [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        most = np.bincount(packing.differencing(sizes, windows), sizes).max()
        best = spread(sizes, windows)
        assert best <= most <= best * 4 / 3 + 1


def test_a_batch_of_the_smallest_documents_stays_small():
    import tracemalloc

    packer = packing._Packer(packing.CAPACITY, packing.WINDOWS, 0)
    tracemalloc.start()
    for i in range(packer.fill + 5):
        packer.add(i, 1)
    packer.close()
    assert tracemalloc.get_traced_memory()[1] < 400 << 20  # the pieces themselves are most of it
    tracemalloc.stop()
    assert len({r[0] for r in packer.rows}) == packer.fill + 5
    loads = {}
    for _, _, n, s, _ in packer.rows:
        loads[s] = loads.get(s, 0) + n
    assert sorted(loads.values())[2:] == [packing.CAPACITY] * packing.WINDOWS and sum(sorted(loads.values())[:2]) == 5


def test_many_windows_rise_until_documents_fit():
    rng = random.Random(6)
    sizes = [rng.randrange(300, 1500) for _ in range(570)]
    of, windows = packing.balanced(sizes, -(-sum(sizes) // 2048), 2048)
    assert windows <= -(-sum(sizes) // 2048) * (1 + packing.SPARE) + 1
