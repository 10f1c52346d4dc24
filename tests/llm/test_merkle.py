import hashlib
import random
import zlib

import pytest

import __spark_entry__
from docsift.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, k int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, text, lang, source, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def climbed(nodes):
    """All levels from nodes to one node."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((nodes[other] if other < len(nodes) else "", at & 1))
        at >>= 1
    return out


def plain(docs):
    rows = []
    for i, text, lang, source, n, *_ in docs:
        bad = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        rows.append(((lang is not None, (lang or "").encode()), (i is not None, i or 0), leaf_of(i, text, lang, source, n), leaf_of(i, text, lang, source, n + 1 if bad else n), i))
    rows.sort(key=lambda r: r[:3])
    parts = sorted({r[0] for r in rows})
    own = {p: [r for r in rows if r[0] == p] for p in parts}
    trees = {p: climbed([r[2] for r in own[p]]) for p in parts}
    top = climbed([trees[p][-1][0] for p in parts])
    out = []
    for k, p in enumerate(parts):
        for at, (_, _, leaf, shown, i) in enumerate(own[p]):
            steps = path(trees[p], at) + path(top, k)
            node = shown
            for sibling, right in steps:
                node = h(sibling, node) if right else h(node, sibling)
            out.append((i, leaf, trees[p][-1][0], top[-1][0], h(*[s for s, _ in steps]), node, node == top[-1][0]))
    return sorted(out, key=str)


def sample(n, seed=3):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["", "é text", f"text {i}"]), rng.choice(["en"] * 8 + ["de", "fr"]), "s", rng.choice([None, i]), "x", 1) for i in range(n)]
    docs += [(n + 1, None, None, None, None, None, None), (None, "a", "en", "s", 3, "x", 1), (None, "a", "en", "s", 3, "x", 1), (None, None, "", "s", 3, "x", 1)]
    docs += [(5, "again", "en", "s", 4, "x", 1), docs[7], docs[7], (n + 2, "lone", "Zz", "s", 9, "x", 1), (n + 3, "big " * 50_000, "中", "s", 9, "x", 1)]
    return docs


@pytest.mark.parametrize("subtree", [1, 2, 3, 5, 8])
def test_traversal_gives_all_paths_with_bounded_memory(subtree):
    for n in (1, 2, 3, 5, 16, 31, 33, 100, 256):
        nodes = [h(str(i)) for i in range(n)]
        height = merkle.height_of(n, 99)
        levels = climbed(nodes)
        read = []

        def leaf(i):
            read.append(i)
            return nodes[i] if i < n else ""

        got = list(merkle.paths(leaf, n, height, subtree))
        assert got == [[s for s, _ in path(levels, i)] for i in range(n)]
        assert merkle.root_of(nodes, height) == levels[-1][0]
        assert len(read) <= 2 * -(-height // subtree) * (1 << height)


def test_growing_subtree_holds_its_levels_only():
    tree = merkle._Growing(2, 4, 0)
    for i in range(16):
        tree.add(h(str(i)))
        assert len(tree.tail) <= 5
    assert [len(r) for r in tree.rows] == [4, 2]


def test_equals_brute_force(spark, tmp_path):
    docs = sample(400)
    spark.createDataFrame(docs, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs)


@pytest.mark.parametrize("height,subtree", [(1, 1), (2, 1), (3, 2), (5, 2)])
def test_blocks_on_blocks_give_the_same(spark, height, subtree):
    """With small blocks the tree has several levels of them, also over the parts."""
    docs = [(i, f"t{i}", f"p{i % 11 if i < 40 else 3}", "s", i) for i in range(90)]
    rows = [(i, "=" + lang, leaf_of(i, t, lang, s, n), leaf_of(i, t, lang, s, n + 1 if zlib.crc32(str(i).encode()) % 7 == 0 else n)) for i, t, lang, s, n in docs]
    leaves = spark.createDataFrame(rows, "doc_id long, part string, leaf string, shown string").repartition(5)
    got = merkle.manifest(leaves, "part", ["doc_id", "leaf"], "leaf", "shown", height, subtree).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs)


def test_lone_and_no_documents(spark, tmp_path):
    for name, docs in (("one", [(14, "only", "en", "s", 2, "x", 1)]), ("none", []), ("lone", [(1, "a", "en", "s", 2, "x", 1), (2, "b", "de", "s", 2, "x", 1)])):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = merkle.op13_merkle_manifest(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got), key=str) == plain(docs)


def test_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["op13_merkle_manifest"])
    assert [c[0] for c in want.description] == COLUMNS
    assert sorted(map(tuple, merkle.op13_merkle_manifest(spark, sf).collect()), key=str) == sorted(want.fetchall(), key=str)
