"""Merkle manifest of a dataset: leaves per part, authentication paths by fractal traversal, one root.

Leaves of a part ascend by key; every two consecutive nodes (a last one alone too) hash to their parent
until one is left, and the parts' roots go on likewise to the root. Positions come from one range sort,
and the tree is cut into aligned blocks of 2^HEIGHT nodes, so a block is the leaves of one complete
subtree and no task holds more than one block of a part. Going up, each block is reduced to its root,
level of blocks by level of blocks; going down, each block meets the proof of its root and a fractal
traversal emits the authentication paths of its nodes one after the other: it keeps a stack of existing
subtrees along the current path and, below the top, the desired subtree that comes next, which grows by
one leaf with each path, so that it is complete when the path moves into it. What it holds is bounded by
the stacked subtrees, whatever the number of leaves. The upper proof is then appended.

Nodes are lowercase hex, '' is an absent node (right of the last), which adds nothing to its parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

HEIGHT = 10
SUBTREE = 5


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parent(left: str, right: str) -> str:
    """The parent of two nodes; an absent right node adds nothing, and two absent nodes have an absent parent."""
    return digest(left + right) if left else ""


def height_of(n: int, most: int) -> int:
    """Levels from n nodes to one, up to most."""
    return min(most, max(0, (n - 1).bit_length()))


class _Growing:
    """A subtree whose nodes are gathered leaf by leaf: those at levels low to top - 1 are kept, by level."""

    def __init__(self, low: int, top: int, first: int):
        self.low, self.top, self.next = low, top, first
        self.rows: list[list[str]] = [[] for _ in range(top - low)]
        self.tail: list[tuple[int, str]] = []  # roots of the complete pieces so far, of falling height

    def add(self, leaf: str) -> None:
        level, node = 0, leaf
        while True:
            if self.low <= level < self.top:
                self.rows[level - self.low].append(node)
            if level == self.top or not self.tail or self.tail[-1][0] != level:
                break
            level, node = level + 1, parent(self.tail.pop()[1], node)
        self.tail.append((level, node))
        self.next += 1


def _grown(leaf: Callable[[int], str], low: int, top: int) -> _Growing:
    tree = _Growing(low, top, 0)
    for i in range(1 << top):
        tree.add(leaf(i))
    return tree


def root_of(nodes: list[str], height: int) -> str:
    """The root of that height over the nodes: absent nodes fill up what is missing."""
    for _ in range(height):
        nodes = [parent(a, b) for a, b in zip(nodes[::2], [*nodes[1::2], ""])]
    return nodes[0]


def paths(leaf: Callable[[int], str], n: int, height: int, subtree: int = SUBTREE) -> Iterator[list[str]]:
    """The siblings, from the leaf upward, of leaf 0, 1, ... n - 1 of a tree of that height."""
    lows = list(range(0, height, subtree))
    tops = [min(low + subtree, height) for low in lows]
    existing = [_grown(leaf, low, top) for low, top in zip(lows, tops)]
    desired = [_Growing(low, top, 1 << top) for low, top in zip(lows, tops[:-1])]
    for at in range(n):
        out = []
        for tree in existing:
            for k, row in enumerate(tree.rows):
                level = tree.low + k
                out.append(row[((at >> level) ^ 1) & ((1 << tree.top - level) - 1)])
        yield out
        for i, tree in enumerate(desired):
            if tree.next < 1 << height:
                tree.add(leaf(tree.next))
            if (at + 1) % (1 << tree.top) == 0:
                existing[i] = tree
                desired[i] = _Growing(tree.low, tree.top, tree.next)


def fold(node: str, path: list[str], at: int) -> str:
    """The node above the path of position at."""
    for sibling in path:
        node = digest(sibling + node if at & 1 else node + sibling)
        at >>= 1
    return node


def placed(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """nodes with pos, the place of a row within its key (ascending, nulls first), and n, the rows of its key.

    One range sort, stored; then counts of each stored partition and key, so no window holds more rows
    than there are partitions, and a frequent key is spread over many.
    """
    cut = nodes.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = common.written(cut.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    runs = rows.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_c"))
    up = Window.partitionBy(key).orderBy("_part")
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("_c").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(key, "_part", (before - F.col("_first")).alias("_add"), F.sum("_c").over(every).alias("n"))
    return rows.join(runs, [key, "_part"]).withColumn("pos", F.col("_row") + F.col("_add")).drop("_part", "_row", "_add")


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """(k, pos, n, node) of blocks of 2^height nodes -> the same of the blocks' roots."""

    def reduce(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos")
        n = rows["n"][0].as_py()
        node = root_of(rows["node"].to_pylist(), height_of(n, height))
        return pa.table({"k": [rows["k"][0].as_py()], "pos": [rows["pos"][0].as_py() >> height], "n": [-(-n >> height)], "node": [node]}, schema=pa.schema([("k", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    return nodes.withColumn("_block", F.shiftright("pos", height)).groupBy("k", "_block").applyInArrow(
        lambda t: reduce(t.select(["k", "pos", "n", "node"])), "k string, pos long, n long, node string"
    )


def _tower(nodes: DataFrame, most: int, height: int) -> list[DataFrame]:
    """nodes, and the roots of their blocks, and so on until each key has one node. most: the largest n."""
    levels = [nodes]
    while most > 1:
        levels.append(common.written(_roots(levels[-1].select("k", "pos", "n", "node"), height)))
        most = -(-most >> height)
    return levels


UPPER = "k string, pos long, path array<string>, at array<boolean>, subroot string, root string"


def _descended(nodes: DataFrame, upper: DataFrame, height: int, subtree: int) -> DataFrame:
    """Proofs (UPPER) of nodes (k, pos, n, node) from those of their blocks' roots; at: the node is right of the sibling."""

    def run(key, own: pa.Table, above: pa.Table) -> pa.Table:
        rows, up = own.sort_by("pos"), above.to_pylist()[0]
        node, first = rows["node"].to_pylist(), rows["pos"][0].as_py()
        high = height_of(rows["n"][0].as_py(), height)
        out = []
        for i, path in enumerate(paths(lambda j: node[j] if j < len(node) else "", len(node), high, subtree)):
            out.append((first + i, path + up["path"], [bool(i >> b & 1) for b in range(high)] + up["at"]))
        return pa.table({
            "k": rows["k"], "pos": [o[0] for o in out], "path": pa.array([o[1] for o in out], pa.list_(pa.string())),
            "at": pa.array([o[2] for o in out], pa.list_(pa.bool_())), "subroot": pa.array([up["subroot"]] * len(out), pa.string()),
            "root": pa.array([up["root"]] * len(out), pa.string()),
        })

    own = nodes.withColumn("block", F.shiftright("pos", height)).groupBy("k", "block")
    return own.cogroup(upper.groupBy("k", "pos")).applyInArrow(run, UPPER)


def proofs_above(nodes: DataFrame, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """Proofs (UPPER) of the roots of the blocks of nodes (k string not null, pos, n, node), over all levels to the root.

    k orders the parts. Where every part has one node, the blocks' roots are the nodes.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = _tower(nodes, most, height)
    if len(levels) == 1:  # a lone node is its own block
        levels.append(nodes.select("k", "pos", "n", "node"))
    tops = levels[-1].select("k", F.col("node").alias("subroot"))
    parts = placed(tops.withColumn("all", F.lit("")), "all", ["k"])
    parts = parts.select(F.col("all").alias("k"), "pos", "n", F.col("subroot").alias("node"), F.col("k").alias("part"))
    above = _tower(parts, parts.agg(F.max("n")).first()[0] or 0, height)
    root = above[-1].select("k", "pos", F.expr("cast(array() as array<string>)").alias("path"), F.expr("cast(array() as array<boolean>)").alias("at"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    upper = root
    for level in reversed(above[:-1]):
        upper = common.written(_descended(level.select("k", "pos", "n", "node"), upper, height, subtree))
    own = upper.join(parts.select("pos", "part", "node"), "pos").select(F.col("part").alias("k"), F.lit(0).cast("long").alias("pos"), "path", "at", F.col("node").alias("subroot"), "root")
    upper = common.written(own)
    for level in reversed(levels[1:-1]):
        upper = common.written(_descended(level.select("k", "pos", "n", "node"), upper, height, subtree))
    return upper


def manifest(leaves: DataFrame, key: str, order: list[str], leaf: str, tampered: str, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """The rows of leaves with subroot, root, proof (siblings upward joined), folded_root and verified.

    key: string column of the part, not null, in the parts' order. order: columns that order the leaves of
    a part; full ties are equal leaves. leaf: the leaf's digest; tampered: the digest to fold along the
    original siblings. No rows: no rows.
    """
    names = leaves.columns
    rows = placed(leaves.select(F.struct(*names).alias("row"), F.col(key).alias("k"), F.col(leaf).alias("node"), F.col(tampered).alias("shown"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]), "k", [f"o{i}" for i in range(len(order))])
    rows = common.written(rows.select("row", "k", "pos", "n", "node", "shown"))
    upper = proofs_above(rows, height, subtree)

    def run(key, own: pa.Table, above: pa.Table) -> pa.Table:
        at, up = own.sort_by("pos"), above.to_pylist()[0]
        node, shown = at["node"].to_pylist(), at["shown"].to_pylist()
        high = height_of(at["n"][0].as_py(), height)
        turn = sum(1 << i for i, right in enumerate(up["at"]) if right)
        tail, above_root = "".join(up["path"]), {}
        proof, folded = [], []
        for i, path in enumerate(paths(lambda j: node[j] if j < len(node) else "", len(node), high, subtree)):
            proof.append(digest("".join(path) + tail))
            block = fold(shown[i], path, i)
            if block not in above_root:
                above_root = {block: fold(block, up["path"], turn)}  # the same for neighbours that nobody changed
            folded.append(above_root[block])
        n = len(node)
        return pa.table({
            "row": at["row"], "subroot": pa.array([up["subroot"]] * n, pa.string()), "root": pa.array([up["root"]] * n, pa.string()),
            "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string()),
        })

    kinds = rows.schema["row"].dataType.simpleString()
    own = rows.withColumn("block", F.shiftright("pos", height)).groupBy("k", "block")
    out = own.cogroup(upper.groupBy("k", "pos")).applyInArrow(run, f"row {kinds}, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select("row.*", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def field(c: Column) -> Column:
    """A value as '-' for null, else its length in UTF-8 bytes, ':' and itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of documents.

    Any field may be null ('-' in the leaf); a null lang is a part of its own before all others, apart from
    the empty string. Null doc_ids come first in their part and are never tampered with; equal doc_ids are
    ordered by leaf, and rows alike in all five columns are equal leaves side by side. A part of one
    document has its leaf as subroot. An empty table gives no rows; other columns are ignored.
    """
    d = common.table(spark, sf_dir, "documents")
    leaf = lambda n: F.sha2(F.concat(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(n), field(F.col("text"))).cast("binary"), 256)
    changed = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + F.lit(1)
    leaves = d.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("part"), leaf(F.col("n_chars")).alias("leaf"),
        F.when(changed, leaf(more)).alias("changed"),
    ).withColumn("shown", F.coalesce("changed", "leaf")).drop("changed")
    return manifest(leaves, "part", ["doc_id", "leaf"], "leaf", "shown").drop("part", "shown")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, lang, n_chars,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS tail,
        coalesce('=' || lang, '') AS part
    FROM documents
), crc AS (
    SELECT CAST(i AS BIGINT) AS i, 0 AS k, CAST(i AS UBIGINT) AS c FROM range(256) r(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END FROM crc WHERE k < 8
), crcs AS (
    SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), dc AS (
    SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL
), run AS (
    SELECT doc_id, s, 0 AS k, CAST(4294967295 AS UBIGINT) AS c FROM dc
    UNION ALL
    SELECT doc_id, s, k + 1, xor(t[CAST(xor(c, CAST(ascii(substr(s, k + 1, 1)) AS UBIGINT)) & 255 AS BIGINT) + 1], c >> 8) FROM run, crcs WHERE k < length(s)
), sums AS (
    SELECT doc_id AS id, xor(c, CAST(4294967295 AS UBIGINT)) AS crc FROM run WHERE k = length(s)
), leaves AS (
    SELECT doc_id, part, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
        CASE WHEN crc % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
    FROM d LEFT JOIN sums ON d.doc_id = sums.id
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), tree AS (
    SELECT part, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY part
    UNION ALL
    SELECT part, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM tree WHERE len(nodes) > 1
), subroots AS (
    SELECT part, nodes[1] AS subroot, row_number() OVER (ORDER BY part) - 1 AS pos FROM tree WHERE len(nodes) = 1
), top AS (
    SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)] FROM top WHERE len(nodes) > 1
), steps AS (
    SELECT p.part, p.pos, 0 AS tier, level, coalesce(nodes[CAST(xor(p.pos >> level, 1) AS BIGINT) + 1], '') AS sibling, (p.pos >> level) & 1 = 1 AS at_right
    FROM placed p JOIN tree t ON p.part = t.part AND len(nodes) > 1
    UNION ALL
    SELECT p.part, p.pos, 1, level, coalesce(nodes[CAST(xor(s.pos >> level, 1) AS BIGINT) + 1], ''), (s.pos >> level) & 1 = 1
    FROM placed p JOIN subroots s ON p.part = s.part, top t WHERE len(nodes) > 1
), path AS (
    SELECT part, pos, list(sibling ORDER BY tier, level) AS siblings, list(at_right ORDER BY tier, level) AS sides FROM steps GROUP BY part, pos
), base AS (
    SELECT p.doc_id, p.part, p.pos, p.leaf, coalesce(p.changed, p.leaf) AS shown, coalesce(siblings, []) AS siblings, coalesce(sides, []) AS sides
    FROM placed p LEFT JOIN path USING (part, pos)
), folds AS (
    SELECT part, pos, 0 AS k, shown AS h, siblings, sides FROM base
    UNION ALL
    SELECT part, pos, k + 1, CASE WHEN sides[k + 1] THEN sha256(siblings[k + 1] || h) ELSE sha256(h || siblings[k + 1]) END, siblings, sides FROM folds WHERE k < len(siblings)
), ends AS (
    SELECT part, pos, h FROM folds WHERE k = len(siblings)
), root AS (
    SELECT nodes[1] AS root FROM top WHERE len(nodes) = 1
)
SELECT b.doc_id, b.leaf, s.subroot, r.root, sha256(array_to_string(b.siblings, '')) AS proof_sha256, e.h AS folded_root, e.h = r.root AS verified
FROM base b JOIN ends e ON b.part = e.part AND b.pos = e.pos JOIN subroots s ON b.part = s.part, root r
"""
