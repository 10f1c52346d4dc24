import random
import re

from docsift.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, row int"


def plain_targets(size):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, free, out = float(sum(size.values())), list(names), {}
    while True:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 3 * size[s] + 1e-9]
        if not over:
            return out | {s: w[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
            free.remove(s)


def sample():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)) + "\n\x85 x", rng.choice("aaaaaabcdZ"), "c", 1) for i in range(900)]
    rows += [(i, "few words\tonly", "é", "c", 1) for i in range(900, 905)]
    return rows + [(1000, None, "a", None, None), (1001, "", None, None, None), (1002, "lone x", None, "", 0), (None, "q", "b", "", 0), rows[3], rows[3], (1003, "big " * 4000, "b", "", 0)]


def test_targets_and_takes(spark):
    rows = sample()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, source = {}, {}
    for i, t, s, *_ in rows:
        size[s] = size.get(s, 0) + n(t)
        source[i] = s
    want, took = plain_targets(size), {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        took[s] = took.get(s, 0) + r.taken
    total = sum(size.values())
    assert all(abs(took[s] - want[s]) <= 8 * max(1, total / mixing.SLOTS) for s in want), (took, want)
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_schedule_keeps_every_stretch_near_its_shares(spark):
    sources = spark.createDataFrame([(0, 0, 1 << 30), (1, 1 << 30, 1 << 32)], "rank int, lo long, hi long")
    got = mixing.schedule(spark, sources, 200_000).collect()
    blocks = {0: [], 1: []}
    for r in sorted(got):
        blocks[r.rank].append(r.block)
    assert all(b == list(range(len(b))) for b in blocks.values()) and len(got) == 200_000
    seen = 0
    for k, r in enumerate(sorted(got), 1):
        seen += r.rank == 0
        assert abs(seen - k / 4) < 6


def test_empty_and_blank(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    r = mixing.mix(spark.createDataFrame([(1, None, "a", "", 0), (2, " ", None, "", 0)], SCHEMA)).collect()
    assert [(x.size, x.target, x.taken) for x in r] == [(0, 0.0, 0)] * 2


def test_small_sources_meet_their_targets_whatever_the_block(spark, monkeypatch):
    """Sources far below a block take their target to the word, in large blocks and in small ones."""
    monkeypatch.setattr(mixing, "MOST_TOKENS", 2048)
    rows = [(i, "w " * 1000, "big", "", 0) for i in range(400)] + [(1000, "w " * 500, "tiny", "", 0), (1001, "w " * 2, "two", "", 0)]
    for slots in (200, 200_000):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), slots=slots).collect()
        of = {}
        for r, (_, _, s, *_) in zip(sorted(got, key=lambda r: r.doc_id), rows):
            of.setdefault(s, [r.target, 0])[1] += r.taken
            assert r.taken <= 3 * r.size
        assert all(taken == round(target) for target, taken in of.values()) and of["tiny"][1] == 1500 and of["two"][1] == 6
