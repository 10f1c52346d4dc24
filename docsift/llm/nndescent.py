"""Embedding near-duplicates by NN-descent.

Only vectors of one label and length are compared, by cosine in double precision. Equal vectors are one
node with a number of copies. Neighbour lists start from random-hyperplane blocks (TABLES of them, of
about BLOCK nodes; a crowded block is dealt into several) and are refined by NN-descent: whatever is
near a node, in either direction, is compared with one another, and lists keep the NEAR best. Rounds go
on while they find links (ROUNDS at most, and no fewer than LEAST_NEW of all), then the result is audited
against brute force over a sample of nodes, enlarged from AUDIT up to MOST_AUDIT until it holds ENOUGH
true links. Below RECALL the descent goes on with new tables, RETRIES times; if recall is still lower, all
pairs of a label are compared, in tiles. A sample without a link has no recall: it is null, not 1.

A list of links alone is saturated: its node may have more. Its list is enlarged to its whole component,
the closure of neighbours of neighbours, whose members are all compared, in tiles of TILE by TILE, so
that a dense group is spread over many tasks and only counts leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.98
TABLES = 5
BLOCK = 128
MOST_BLOCK = 256
NEAR = 8
TILE = 512
AUDIT, MOST_AUDIT, ENOUGH = 256, 4096, 300
RECALL = 0.97
ROUNDS, LEAST_NEW, RETRIES = 8, 0.001, 4
PIVOTS = 32
MOST_PIVOT = 64
PAIRS = "u long, v long, sim double"


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of one length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, h1, h2, grp) and (nodes: node, grp, vec, copies, least, h1, h2)."""
    v = F.col(vector_col).cast("array<double>")
    zero = F.lit(0.0)
    sound = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(v, lambda x: x != zero)
    grp = F.concat_ws(":", F.col(label_col).cast("string"), F.size(v).cast("string"))
    rows = vectors.select(
        F.col(id_col).alias("id"), F.when(sound, grp).alias("grp"), F.when(sound, F.transform(v, lambda x: x + zero)).alias("vec")
    ).select("id", "grp", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    nodes = rows.where("grp is not null").groupBy("grp", "h1", "h2").agg(
        F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least")
    ).withColumn("node", F.monotonically_increasing_id())
    return rows.drop("vec"), common.written(nodes)


def _blocks(nodes: DataFrame, first: int, tables: int) -> DataFrame:
    """(blk, node): blocks of nodes that fall on the same sides of random planes, MOST_BLOCK or so at most."""
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / BLOCK))).cast("int")
    src = nodes.join(sizes.select("grp", bits.alias("bits")), "grp").select("node", "grp", "bits", "vec")

    def code(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            keys = np.zeros((n, tables), np.int64)
            bits_of, length = b.column(2).to_numpy(), np.diff(b.column(3).offsets.to_numpy())
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                x = unit(b.column(3).take(pa.array(at)))
                for t in range(tables):
                    most = int(bits_of[at].max())
                    if not most:
                        continue
                    k = (int(dim), first + t)
                    if k not in planes or len(planes[k]) < most:
                        planes[k] = np.random.default_rng([k[0], k[1], 77]).standard_normal((62, k[0]))
                    side = (x @ planes[k][:most].T > 0).astype(np.int64)
                    used = np.arange(most)[None, :] < bits_of[at][:, None]
                    keys[at, t] = ((side * used) << np.arange(most)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["node", "grp", "keys"])

    coded = common.written(src.mapInArrow(code, "node long, grp string, keys array<long>"))
    each = coded.select("node", "grp", F.posexplode("keys").alias("t", "key"))
    crowd = each.groupBy("grp", "t", "key").agg(F.count("*").alias("c"))
    dealt = each.join(crowd, ["grp", "t", "key"])
    salt = F.pmod(F.xxhash64("node", "t"), F.greatest(F.lit(1), F.ceil(F.col("c") / MOST_BLOCK)).cast("long"))
    return dealt.select(F.xxhash64("grp", F.col("t") + first, "key", salt).alias("blk"), "node")


def _within_blocks(blocks: DataFrame, nodes: DataFrame, near: int) -> DataFrame:
    """(u, v, sim): each node's nearest in its block. (Two blocks whose hashes met would only be compared too.)"""

    def nearest(t: pa.Table) -> pa.Table:
        u, g = t.column("node").to_numpy(), np.array(t.column("grp").to_pylist())
        out = []
        for name in np.unique(g):
            at = np.flatnonzero(g == name)
            if len(at) < 2:
                continue
            x = unit(t.column("vec").take(pa.array(at)))
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(near, len(at) - 1)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(u[at], k), u[at][best].ravel(), np.take_along_axis(s, best, axis=1).ravel()))
        return _pairs(*map(np.concatenate, zip(*out))) if out else _pairs([], [], [])

    with_vec = blocks.join(nodes.select("node", "grp", "vec"), "node")
    return with_vec.groupBy("blk").applyInArrow(nearest, PAIRS)


def _best(pairs: DataFrame, near: int) -> DataFrame:
    """The near best of each u, with fresh: false where an earlier list had it."""
    one = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= near).drop("r")


def _local_joins(lists: DataFrame, nodes: DataFrame, near: int, threshold: float) -> DataFrame:
    """(u, v, sim) that beat u's list, among nodes that share a neighbour, in either direction."""
    both = lists.select(F.col("u").alias("p"), F.col("v").alias("m"), "fresh").unionByName(
        lists.select(F.col("v").alias("p"), F.col("u").alias("m"), "fresh")
    ).groupBy("p", "m").agg(F.max("fresh").alias("fresh"))
    sizes = both.groupBy("p").agg(F.count("*").alias("c"), F.max("fresh").alias("any")).where("any").select("p", "c")
    salt = F.pmod(F.xxhash64("m", "p"), F.ceil(F.col("c") / MOST_PIVOT).cast("long"))
    least = lists.groupBy("u").agg(F.min("sim").alias("least"), F.count("*").alias("held"))
    held = F.when(F.col("held") < near, -2.0).when(F.col("least") >= threshold, 2.0).otherwise(F.col("least"))  # saturated: enlarged later
    floor = least.select(F.col("u").alias("m"), held.alias("floor"))
    many = F.lit(1 << 40)
    placed = both.join(sizes, "p").select("p", salt.alias("s"), "m", "fresh")
    info = nodes.select(F.col("node").alias("m"), "vec").join(floor, "m", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    rows = placed.join(info, "m").withColumn("blk", F.pmod(F.xxhash64("p", "s"), many))
    total = max(1, nodes.count() // PIVOTS)

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([("p", "ascending"), ("s", "ascending")])
        p, s, m = (t.column(c).to_numpy() for c in ("p", "s", "m"))
        fresh, floor_of = t.column("fresh").to_numpy(), t.column("floor").to_numpy()
        length = np.diff(t.column("vec").combine_chunks().offsets.to_numpy())
        cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 0) | (np.diff(length) != 0)) + 1
        us, vs, ss = [], [], []
        for a, b in zip([0, *cut], [*cut, len(p)]):
            if b - a < 2 or not fresh[a:b].any():
                continue
            x = unit(t.column("vec").slice(a, b - a))
            sim = x @ x.T
            new = (fresh[a:b, None] | fresh[None, a:b]) & (m[a:b, None] != m[None, a:b])
            i, j = np.nonzero(new & (sim > floor_of[a:b, None]))
            us.append(m[a:b][i])
            vs.append(m[a:b][j])
            ss.append(sim[i, j])
        if not us:
            return _pairs([], [], [])
        u, v, sim = map(np.concatenate, (us, vs, ss))
        order = np.lexsort((v, -sim, u))  # of what this group found, each u's best; a pair of two pivots once
        u, v, sim = u[order], v[order], sim[order]
        once = np.ones(len(u), bool)
        once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        u, v, sim = u[once], v[once], sim[once]
        start = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, int)
        rank = np.arange(len(u)) - np.repeat(start, np.diff(np.append(start, len(u))))
        return _pairs(u[rank < near], v[rank < near], sim[rank < near])

    return rows.withColumn("blk", F.pmod("blk", F.lit(total))).groupBy("blk").applyInArrow(join, PAIRS)


def _audit(nodes: DataFrame, size: int, threshold: float) -> DataFrame:
    """(u, v): all links of a sample of nodes, by brute force against every node."""
    spark = nodes.sparkSession
    rows = nodes.orderBy(F.xxhash64("node", F.lit(3))).limit(size).select("node", "grp", "vec").toArrow()
    names = rows.column("grp").to_pylist()
    sample = {}
    for name in set(names):
        at = [i for i, g in enumerate(names) if g == name]
        sample[name] = (rows.column("node").to_numpy()[at], unit(rows.column("vec").take(pa.array(at))))
    held = spark.sparkContext.broadcast(sample)  # AUDIT vectors at most

    def brute(batches):
        for b in batches:
            node, g = b.column(0).to_numpy(), np.array(b.column(1).to_pylist())
            for name in np.unique(g):
                if name in held.value:
                    at = np.flatnonzero(g == name)
                    u, x = held.value[name]
                    y = unit(b.column(2).take(pa.array(at))).T
                    for k in range(0, len(u), 256):
                        i, j = np.nonzero(x[k : k + 256] @ y >= threshold)
                        one, other = u[k + i], node[at][j]
                        keep = one != other
                        yield pa.RecordBatch.from_arrays([pa.array(one[keep], pa.int64()), pa.array(other[keep], pa.int64())], names=["u", "v"])

    return nodes.select("node", "grp", "vec").mapInArrow(brute, "u long, v long")


def _truth(nodes: DataFrame, threshold: float) -> DataFrame:
    """The links of the least sample that holds ENOUGH of them, or of the largest."""
    size, total = AUDIT, nodes.count()
    while True:
        truth = common.written(_audit(nodes, size, threshold))
        if size >= min(MOST_AUDIT, total) or truth.count() >= ENOUGH:
            return truth
        common.discard(truth)
        size *= 4


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v, sim): every link, by comparing all nodes of a label in tiles."""
    tiles = F.ceil(F.col("n") / TILE).cast("long")
    own = nodes.join(nodes.groupBy("grp").agg(F.count("*").alias("n")), "grp").select(
        "node", "grp", "vec", F.pmod(F.xxhash64("node", F.lit(9)), tiles).alias("own"), tiles.alias("tiles"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    spread = spread.select("node", "grp", "vec", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def links(t: pa.Table) -> pa.Table:
        node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
        a, b = np.flatnonzero(own == t.column("i")[0].as_py()), np.flatnonzero(own == t.column("j")[0].as_py())
        if not len(a) or not len(b):
            return _pairs([], [], [])
        x = unit(t.column("vec"))
        sim = x[a] @ x[b].T
        p, q = np.nonzero((sim >= threshold) & (node[a][:, None] != node[b][None]))
        return _pairs(np.concatenate((node[a][p], node[b][q])), np.concatenate((node[b][q], node[a][p])), np.tile(sim[p, q], 2))

    return spread.groupBy("grp", "i", "j").applyInArrow(links, PAIRS).dropDuplicates(["u", "v"])


def _recall(truth: DataFrame, pairs: DataFrame, dense: DataFrame) -> float | None:
    """The part of the audited links that a list holds or that the enlarged lists will; None without any."""
    n = truth.count()
    if not n:
        return None
    of = lambda c: dense.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    listed = truth.join(pairs.withColumn("listed", F.lit(True)), ["u", "v"], "left").join(of("u"), "u", "left").join(of("v"), "v", "left")
    return listed.where(F.col("listed") | (F.col("c_u") == F.col("c_v"))).count() / n


def _dense_counts(dense: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, links): copies of the nodes linked to u, by comparing all members of its component in tiles. dense: node, component, size."""
    n = F.ceil(F.col("size") / TILE).cast("long")
    own = F.pmod(F.xxhash64("node", F.lit(9)), n)
    spread = dense.select("node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    tiles = spread.select("node", "own", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = tiles.join(nodes.select("node", "vec", "copies"), "node")

    def count(t: pa.Table) -> pa.Table:
        node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        x = unit(t.column("vec"))
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = x[a] @ x[b].T >= threshold
        if i == j:
            np.fill_diagonal(near, False)
            links = near @ copies[b]
            return pa.table({"u": pa.array(node[a], pa.int64()), "links": pa.array(links, pa.int64())})
        return pa.table({
            "u": pa.array(np.concatenate((node[a], node[b])), pa.int64()),
            "links": pa.array(np.concatenate((near @ copies[b], copies[a] @ near)), pa.int64()),
        })

    return rows.groupBy("component", "i", "j").applyInArrow(count, "u long, links long").groupBy("u").agg(F.sum("links").alias("links"))


def _saturated(links: DataFrame, near: int) -> DataFrame:
    """(u): nodes whose list holds links alone."""
    return links.groupBy("u").agg(F.count("*").alias("c")).where(F.col("c") >= near).select("u")


def _descended(lists: DataFrame | None, nodes: DataFrame, first: int, near: int, threshold: float) -> DataFrame:
    """The lists, if any, with TABLES new tables, refined as long as lists that aren't saturated get links."""
    found = _within_blocks(_blocks(nodes, first, TABLES), nodes, near).withColumn("fresh", F.lit(True))
    if lists is not None:
        found = found.unionByName(lists.withColumn("fresh", F.lit(False)))
    before, lists = lists, common.written(_best(found, near))
    common.discard(before)
    for _ in range(ROUNDS):
        joined = _local_joins(lists, nodes, near, threshold).withColumn("fresh", F.lit(True))
        new = common.written(_best(lists.withColumn("fresh", F.lit(False)).unionByName(joined), near))
        common.discard(lists)
        lists = new
        links = lists.where(F.col("sim") >= threshold)
        got = links.join(_saturated(links, near), "u", "left_anti").agg(F.count_if("fresh").alias("new"), F.count("*").alias("all")).first()
        if got["new"] <= LEAST_NEW * got["all"]:
            break
    return lists


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, near: int = NEAR, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept, recall (as audited; null without a true link).

    Null labels and vectors, empty and zero vectors and such with null or non-finite components link with
    nothing. Copies count as links of each other. Repeated rows stay; a null id is its own component
    unless it has links; other columns are ignored.
    """
    rows, nodes = _classes(vectors, id_col, vector_col, label_col)
    lists, truth = None, _truth(nodes, threshold)
    for retry in range(RETRIES + 2):
        if retry > RETRIES:
            links = common.written(_all_links(nodes, threshold))
            full = links.groupBy("u").agg(F.count("*").alias("c")).where(F.col("c") >= near).select("u")
        else:
            lists = _descended(lists, nodes, retry * TABLES, near, threshold)
            links = lists.where(F.col("sim") >= threshold)
            full = _saturated(links, near)
        pairs = common.written(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        label = common.written(common.connected_components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))))
        sizes = label.groupBy("component").agg(F.count("*").alias("size"))
        dense_of = label.join(full.withColumnRenamed("u", "node"), "node", "left_semi").select("component").distinct().join(sizes, "component")
        dense = common.written(label.join(dense_of, "component"))
        recall = _recall(truth, pairs, dense)
        if recall is None or recall >= RECALL:
            break
        if retry <= RETRIES:
            common.discard(pairs, label, dense)
    counted = _dense_counts(dense, nodes, threshold)
    plain = pairs.join(dense.select(F.col("node").alias("u")), "u", "left_anti").join(
        nodes.select(F.col("node").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("links"))
    degree = common.written(plain.unionByName(counted))
    known = nodes.select("node", "grp", "h1", "h2", "copies", "least").join(degree.withColumnRenamed("u", "node"), "node", "left")
    known = known.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    info = known.join(named, "component").select(
        "grp", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"
    )
    out = rows.join(info, ["grp", "h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(recall).cast("double"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall for every row of embeddings.

    Null labels and vectors, empty and zero vectors and those with null or non-finite components have no
    links and are their own component. Equal vectors of a label link; repeated rows stay; a null id is its
    own component unless it has links; an empty table gives no rows; other columns are ignored.
    """
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
