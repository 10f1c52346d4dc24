import numpy as np
import pytest

from docsift.llm import nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, node string, grp int"


def sample():
    rng = np.random.default_rng(4)
    rows, i = [], 0

    def put(x, label):
        nonlocal i
        rows.append((i * 3 % 1009, None if x is None else [None if v is None else float(v) for v in x], label, "x", 1))
        i += 1

    for label in (0, 1):
        base = rng.standard_normal((70, 16))
        for b in base:
            put(b, label)
        for b in base[:12]:
            put(b + rng.standard_normal(16) * 0.05, label)
        for _ in range(60):  # a dense group
            put(base[20] + rng.standard_normal(16) * 0.08, label)
        for _ in range(5):
            put(base[30], label)
        put(base[31] * 1000, label)
    for x, label in [(None, 0), ([], 0), ([0.0] * 16, 0), ([None] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 1), (rows[3][1], None), (rows[3][1][:8], 0)]:
        put(x, label)
    return rows


def plain(rows):
    ok = lambda x: bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)
    n, links = len(rows), {k: set() for k in range(len(rows))}
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if ok(r[1]) else None for r in rows]
    for a in range(n):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[rows[a][0]] = (len(links[a]), min(rows[b][0] for b in seen))
    return out


@pytest.mark.parametrize("near", [8, 3])
def test_against_brute_force(spark, near):
    rows = sample()
    got = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA), near=near).collect()
    want = plain(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    links = sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.95 * links
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= 0.97 * len(got)


def test_empty_repeats_and_null_ids(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, [1.0, 2.0], 1, "", 0), (5, [1.0, 2.0], 1, "", 0), (None, [1.0, 2.0], 1, "", 0), (None, None, 1, "", 0)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 5), (5, 2, 5), (5, 2, 5)]


def test_exact_comparison_when_recall_stays_low(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "RECALL", 2.0)
    monkeypatch.setattr(nndescent, "RETRIES", 0)
    monkeypatch.setattr(nndescent, "TILE", 32)
    rows = sample()
    got = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain(rows) and {r.recall for r in got} == {1.0}


def test_recall_is_null_where_nothing_could_be_measured(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.standard_normal(16)], 0, "", 0) for i in range(80)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 80 and all(r.n_links == 0 and r.recall is None for r in got)
