"""Uniform manifold approximation as Spark jobs: graph, memberships, layout.

* Graph: points are dealt into cells by random projections, and each point
  keeps its nearest within them.  Rounds of neighbour descent follow: the
  neighbours of a point (a bounded sample, both ways) are compared with each
  other, until a round moves few edges; only pairs within a point's reach so
  far leave a task.  A table of one cell is compared whole.
* Memberships: distances of a point are scaled so that they sum to log2 of
  their number, and both directions of an edge are joined as a fuzzy union.
* Layout: from principal components, by sampled gradient steps.  A task holds
  the points of one block, their edges, and where the other ends stood at the
  start of the round; blocks are dealt by hash, so a block's own points are
  the random ones that repel.

All draws come from the seed, the round and the block, so a table has one
layout.  No step collects rows, and every group has a bounded size.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: points of a cell in which all pairs are compared, and of a block of the layout
CELL, BLOCK = 2048, 8192
#: random projections that deal the first cells, and neighbours of a point that one descent round compares
TREES, SAMPLE = 4, 8
#: points whose lists one task compares at a time
LOT = 1024
#: descent ends when a round moves fewer than this share of the edges
SETTLED, MOST_ROUNDS = 0.005, 12
#: epochs of gradient steps in all, and rounds they are parted in where there are several blocks
EPOCHS, ROUNDS = 200, 40
NEGATIVES = 5


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest_within(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour, distance) of each point's ``k`` nearest others; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0)
    square = (x * x).sum(1)
    us, vs, ds = [], [], []
    for a in range(0, len(ids), 512):
        d = np.maximum(0, square[a : a + 512, None] + square[None] - 2 * x[a : a + 512] @ x.T)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, :k]
        us.append(np.repeat(ids[a : a + 512], k))
        vs.append(ids[near].ravel())
        exact = x[np.repeat(np.arange(a, a + len(d)), k)] - x[near.ravel()]
        ds.append(np.sqrt((exact * exact).sum(1)))
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


def nearer_pairs(at: np.ndarray, ids: np.ndarray, x: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour, distance) of the pairs of one list (rows of equal ``at``) that are within the point's ``bar``."""
    order = np.lexsort((ids, at))
    order = order[np.concatenate(([True], (np.diff(at[order]) != 0) | (np.diff(ids[order]) != 0)))] if len(order) else order
    at, ids, x, bar = at[order], ids[order], x[order], bar[order]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, int)
    sizes = np.diff(np.concatenate((starts, [len(at)])))
    square = (x * x).sum(1)
    us, vs, ds = [ids[:0]], [ids[:0]], [np.zeros(0)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        rows = starts[sizes == size][:, None] + np.arange(size)
        own = square[rows]
        about = own[:, :, None] + own[:, None] - 2 * x[rows] @ x[rows].transpose(0, 2, 1)
        near = about <= bar[rows][:, :, None] ** 2 + 1e-9 * (own[:, :, None] + own[:, None])
        near[:, np.arange(size), np.arange(size)] = False
        g, i, j = np.nonzero(near)
        u, v = rows[g, i], rows[g, j]
        exact = x[u] - x[v]
        d = np.sqrt((exact * exact).sum(1))
        keep = d <= bar[u]
        us.append(ids[u[keep]]), vs.append(ids[v[keep]]), ds.append(d[keep])
    return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


EDGES = "u long, v long, d double"


def edge_table(u, v, d) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d, pa.float64())})


def closest(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each point; only that many leave a task."""
    w = Window.partitionBy("u").orderBy("d", "v")
    return edges.where("u != v").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def first_cells(points: DataFrame, n: int, dims: int, seed: int) -> DataFrame:
    """(cell, id, x): each point once for each tree, cells of CELL points by signs of random projections."""
    bits = max(0, math.ceil(math.log2(n / CELL * 2))) if n > CELL else 0
    trees = TREES if bits else 1
    planes = np.random.default_rng(seed).normal(size=(trees, bits, dims))
    some = points.select("x").limit(1000).toArrow().column("x") if bits else None  # planes pass through the middle of a sample
    middle = matrix(some).mean(0) if bits else 0.0

    def deal(batches):
        for b in batches:
            x = matrix(b.column(1))
            for t in range(trees):
                sign = ((x - middle) @ planes[t].T > 0).astype(np.int64) if bits else np.zeros((len(x), 0), np.int64)
                code = sign @ (1 << np.arange(bits, dtype=np.int64)) + (t << 40)
                yield pa.RecordBatch.from_arrays([pa.array(code), b.column(0), b.column(1)], names=["cell", "id", "x"])

    dealt = staged(points.select("id", "x").mapInArrow(deal, "cell long, id long, x array<double>"), "manifold-cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("pieces"))  # one row a cell
    return dealt.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("pieces")).cast("int"))


def neighbour_graph(points: DataFrame, k: int = 15, seed: int = 42) -> DataFrame:
    """(u, v, d): the ``k`` nearest others of each point (id, x) by Euclidean distance.

    Exact for a table of one cell; larger ones come close to it by descent.
    """
    head = points.agg(F.count("*"), F.max(F.size("x"))).first()
    n, dims = head[0], head[1] or 0

    def inside(t: pa.Table) -> pa.Table:
        return edge_table(*nearest_within(t.column("id").to_numpy(), matrix(t.column("x")), k))

    cells = first_cells(points, n, dims, seed)
    graph = staged(closest(cells.groupBy("cell", "piece").applyInArrow(inside, EDGES), k), "manifold-graph")
    if n <= CELL:
        return graph

    def compared(t: pa.Table) -> pa.Table:
        return edge_table(*nearer_pairs(t.column("at").to_numpy(), t.column("id").to_numpy(), matrix(t.column("x")), t.column("bar").to_numpy()))

    lots = max(1, -(-n // LOT))
    for r in range(MOST_ROUNDS):
        draw = F.xxhash64("u", "v", F.lit(seed + r))
        both = graph.select(F.col("u").alias("at"), F.col("v").alias("id"), draw.alias("h")).union(graph.select(F.col("v").alias("at"), F.col("u").alias("id"), draw.alias("h")))
        w = Window.partitionBy("at").orderBy("h", "id")
        lists = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * SAMPLE).select("at", "id")
        lists = lists.union(graph.select(F.col("u").alias("at"), F.col("u").alias("id")).distinct())
        reach = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("bar"))
        known = points.select("id", "x").join(reach.withColumnRenamed("u", "id"), "id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
        met = lists.join(known, "id").withColumn("lot", F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(lots)))
        found = met.groupBy("lot").applyInArrow(compared, EDGES)
        last, graph = graph, staged(closest(graph.union(found), k), "manifold-graph")
        moved = graph.join(last, ["u", "v"], "left_anti").count()
        if moved < SETTLED * k * n:
            break
    return graph


def scales(d: np.ndarray) -> np.ndarray:
    """Membership of each distance, rows of one point: 1 for its nearest, and log2 of their number in all."""
    k = d.shape[1]
    positive = np.where(d > 0, d, np.inf)
    rho = np.where(np.isfinite(positive.min(1)), positive.min(1), 0.0)
    beyond = np.maximum(d - rho[:, None], 0)
    low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    want = np.log2(max(2, k))
    for _ in range(64):
        much = np.exp(-beyond / sigma[:, None]).sum(1) > want
        high, low = np.where(much, sigma, high), np.where(much, low, sigma)
        sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
        sigma = np.clip(sigma, 1e-12, 1e12)
    least = 1e-3 * np.maximum(d.mean(1), 1e-12)
    return np.exp(-beyond / np.maximum(sigma, least)[:, None])


def memberships(graph: DataFrame) -> DataFrame:
    """(u, v, w), u < v: the fuzzy union of both directions of each edge."""
    lists = graph.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("e"))  # k of them

    def weigh(batches):
        for b in batches:
            e = b.column(1)
            sizes = np.diff(e.offsets.to_numpy())
            d, v = e.flatten().field("d").to_numpy(), e.flatten().field("v").to_numpy()
            at = np.concatenate(([0], np.cumsum(sizes)))
            w = np.empty(len(d))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                take = at[rows][:, None] + np.arange(size)
                w[take] = scales(d[take])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(v), pa.array(w)], names=["u", "v", "w"])

    one_way = lists.mapInArrow(weigh, "u long, v long, w double")
    pair = one_way.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("w").alias("s"), F.min("w").alias("x"), F.max("w").alias("y"), F.count("*").alias("c"))
    return pair.select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("s") - F.when(F.col("c") > 1, F.col("x") * F.col("y")).otherwise(0.0)).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), nearest to 1 up to ``min_dist`` and an exponential beyond (Gauss-Newton)."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([0.5, 0.0])  # logarithms keep both positive
    for _ in range(200):
        a, b = np.exp(p)
        power = a * d ** (2 * b)
        f = 1 / (1 + power)
        slope = -f * f * power
        jacobian = np.stack((slope, slope * 2 * b * np.log(d)), 1)
        step = np.linalg.lstsq(jacobian, want - f, rcond=None)[0]
        p = p + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-12:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def gradient_epochs(own: np.ndarray, other: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, a: float, b: float, alphas: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positions of a block's points after some epochs.

    Edge (u, v) pulls point ``u``; ``v`` counts on from the block's points to
    ``other``, which stand still.  An edge is used in an epoch with the
    probability of its weight, and NEGATIVES random points of the block push.
    """
    n = len(own)
    y = np.concatenate((own, other))
    for alpha in alphas:
        used = np.flatnonzero(rng.random(len(w)) < w)
        rng.shuffle(used)
        lots = max(1, -(-len(used) // max(1, n // 2)))
        for at in np.array_split(used, lots):
            i, j = u[at], v[at]
            gap = y[i] - y[j]
            square = (gap * gap).sum(1)
            pull = np.where(square > 0, -2 * a * b * np.maximum(square, 1e-12) ** (b - 1) / (1 + a * square**b), 0)
            move = np.clip(pull[:, None] * gap, -4, 4)
            far = np.repeat(i, NEGATIVES)
            against = rng.integers(0, n, len(far))
            gap = y[far] - y[against]
            square = (gap * gap).sum(1)
            push = np.where(far != against, 2 * b / ((0.001 + square) * (1 + a * square**b)), 0)
            apart = np.clip(push[:, None] * gap, -4, 4)
            for c in range(y.shape[1]):
                y[:n, c] += alpha * (np.bincount(i, move[:, c], n) + np.bincount(far, apart[:, c], n))
    return y[:n]


def layout(start: DataFrame, edges: DataFrame, dims: int, min_dist: float = 0.1, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """(id, y): positions of all points after ``epochs`` of gradient steps from ``start`` (id, y)."""
    n = start.count()
    a, b = curve(min_dist)
    blocks = max(1, -(-n // BLOCK))
    rounds = min(ROUNDS, epochs) if blocks > 1 else 1
    alphas = np.array_split(1 - np.arange(epochs) / epochs, rounds)
    block_of = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    most = edges.agg(F.max("w")).first()[0] or 1.0
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    both = staged(both.select(block_of("u").alias("block"), "u", "v", (F.col("w") / most).alias("w")), "manifold-edges")
    at = staged(start.select("id", "y"), "manifold-layout")
    for r in range(rounds):
        def step(key: tuple, e: pa.Table, p: pa.Table) -> pa.Table:
            ids = p.column("id").to_numpy()
            order = np.argsort(ids)
            ids, y = ids[order], matrix(p.column("y"))[order]
            u, v, w = (e.column(c).to_numpy() for c in ("u", "v", "w"))
            line = np.lexsort((v, u))
            u, v, w, there = u[line], v[line], w[line], matrix(e.column("there"))[line] if len(e) else np.zeros((0, dims))
            inside = np.isin(v, ids)
            outer, first = np.unique(v[~inside], return_index=True)
            place = np.where(inside, np.searchsorted(ids, v), len(ids) + np.searchsorted(outer, v))
            rng = np.random.default_rng([seed, r, key[0].as_py()])
            y = gradient_epochs(y, there[~inside][first], np.searchsorted(ids, u), place, w, a, b, alphas[r], rng)
            return pa.table({"id": pa.array(ids), "y": pa.array(y.tolist(), pa.list_(pa.float64()))})

        met = both.join(at.select(F.col("id").alias("v"), F.col("y").alias("there")), "v")
        own = at.select(block_of("id").alias("block"), "id", "y")
        at = staged(met.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(step, "id long, y array<double>"), "manifold-layout")
    return at


def umap_embed(vectors: DataFrame, features: str = "features", dims: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, epochs: int = EPOCHS, seed: int = 42) -> DataFrame:
    """Add ``embedding``: the manifold layout of the vectors in ``dims`` dimensions.

    Rows with a null vector, a null or non-finite component or another length
    than the first row's are left out of the graph and get a null embedding.
    Equal vectors are points of their own.  Tables of fewer rows than
    neighbours use all others; a single row lies at the origin.
    """
    from .split import embed

    numbered = staged(vectors.withColumn("__id", F.monotonically_increasing_id()), "manifold-input")
    x = F.col(features).cast("array<double>")
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = numbered.where(ok).select(F.col("__id").alias("id"), x.alias("x"))
    width = good.agg(F.min_by(F.size("x"), "id")).first()[0] or 0
    points = staged(good.where((F.size("x") == F.lit(width)) & (F.size("x") > 0)), "manifold-points")
    n = points.count()
    if n < 3 or width < 1:
        here = points.select(F.col("id").alias("__id"), F.array(*[F.lit(0.0)] * dims).alias("embedding"))
        return numbered.join(here, "__id", "left").drop("__id")
    graph = neighbour_graph(points, min(n_neighbors, n - 1), seed)
    edges = staged(memberships(graph), "manifold-memberships")
    k = min(dims, width)
    flat = embed(points.select("id", "x"), "x", k)
    widest = flat.agg(*[F.max(F.abs(F.col("embedding")[i])).alias(f"m{i}") for i in range(k)]).first()
    scale = 10 / max(max(widest), 1e-12)
    noise = [(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(1_000_003)) / 1_000_003.0 - 0.5) * 1e-3 for i in range(dims)]
    start = flat.select("id", F.array(*[(F.col("embedding")[i] * scale if i < k else F.lit(0.0)) + noise[i] for i in range(dims)]).alias("y"))
    placed = layout(start, edges, dims, min_dist, epochs, seed)
    return numbered.join(placed.select(F.col("id").alias("__id"), F.col("y").alias("embedding")), "__id", "left").drop("__id")
