"""Random forests and extremely randomised trees from histograms, whatever the row count.

Features are cut into bins once.  Trees grow level by level: a task adds up
weight and response by tree, node, feature and bin over its own rows; the sums
of a node meet in one task, which picks the node's cut; one row a node comes
back.  The driver holds the trees alone, never a row.

A bootstrap gives a row a Poisson weight for each tree, drawn from the row's
key, so every attempt of a task draws alike.  With one bin a value the trees
are those of the exact kernel on the same rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.trees import Forest, Tree, n_candidates
from ..sources.tables import staged

BINS = 64
#: sums that one task holds at a time: more nodes take further passes
HISTOGRAM_BYTES = 64 << 20
U = np.uint64


def edges_of(df: DataFrame, features: str, dims: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each feature: between all its values if ``bins`` hold them, else at quantiles."""
    cells = df.select(F.posexplode(features).alias("f", "v")).where(F.col("f") < dims)
    share = [i / bins for i in range(1, bins)]
    few = cells.groupBy("f", "v").agg(F.lit(1)).groupBy("f").agg(F.count("*").alias("n"))
    few = few.where(F.col("n") <= bins).select("f")
    values = cells.join(F.broadcast(few), "f").groupBy("f").agg(F.sort_array(F.collect_set("v")).alias("q"))  # one row a feature, ``bins`` values
    spread = cells.join(F.broadcast(few), "f", "left_anti").groupBy("f").agg(F.percentile_approx("v", share, 10_000).alias("q"))
    out = [np.zeros(0)] * dims
    for r in values.collect():
        q = np.array(r["q"], float)
        out[r["f"]] = (q[1:] + q[:-1]) / 2
    for r in spread.collect():
        out[r["f"]] = np.unique(np.array(r["q"], float))
    return out


def binned(df: DataFrame, key: str, features: str, target: str, edges: list[np.ndarray]) -> DataFrame:
    """(h, y, bins): a hash of each row's key, its response, and a byte a feature; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary())], names=["h", "y", "bins"])

    ok = F.col(target).isNotNull() & F.forall(features, lambda v: v.isNotNull())
    rows = df.where(ok).select(F.xxhash64(key).alias("h"), F.col(target).cast("double").alias("y"), F.col(features).cast("array<double>").alias("x"))
    return staged(rows.mapInArrow(cut, "h long, y double, bins binary"), "forest-bins")


def poisson_weights(h: np.ndarray, tree: int, seed: int, rate: float) -> np.ndarray:
    """Poisson weights that a row's hash, the tree and the seed decide."""
    with np.errstate(over="ignore"):
        x = h.view(U) ^ U((seed * 0x9E3779B97F4A7C15 + tree * 0xD1342543DE82EF95) & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> U(shift))) * U(factor)
        x ^= x >> U(31)
    uniform = (x >> U(11)).astype(float) / float(1 << 53)
    steps = np.exp(-rate) * np.cumprod(np.concatenate(([1.0], rate / np.arange(1, 24))))
    return np.searchsorted(np.cumsum(steps), uniform, "right").astype(float)


class Growing:
    """The arrays of a tree under way; cuts are bins until it is done."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value, self.gain, self.depth = ([] for _ in range(7))

    def node(self, value: float, depth: int) -> int:
        for column, v in zip((self.feature, self.bin, self.left, self.right, self.value, self.gain, self.depth), (-1, 0, 0, 0, value, 0.0, depth)):
            column.append(v)
        return len(self.value) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(map(np.array, (self.feature, self.bin, self.left, self.right)))


def at_nodes(arrays: tuple[np.ndarray, ...], code: np.ndarray) -> np.ndarray:
    """The node of the tree so far in which each row stands."""
    feature, cut, left, right = arrays
    at = np.zeros(len(code), np.int64)
    while (live := np.flatnonzero(feature[at] >= 0)).size:
        n = at[live]
        at[live] = np.where(code[live, feature[n]] <= cut[n], left[n], right[n])
    return at


def best_cut(sums: np.ndarray, features: np.ndarray, edges: list[np.ndarray], least: float, rng: np.random.Generator | None) -> tuple[float, int, int, float, float, bool]:
    """(gain, feature, bin, left weight, left sum, any feature that varies) of a node's sums, shape (features, bins, 2).

    ``rng`` draws one cut a feature between the least and the greatest bin
    there; without it every cut is tried.
    """
    found, varies = (1e-12, -1, 0, 0.0, 0.0), False
    for f, s in zip(features.tolist(), sums):
        there = np.flatnonzero(s[:, 0] > 0)
        if len(there) < 2:
            continue
        varies = True
        w, y = np.cumsum(s[:, 0]), np.cumsum(s[:, 1])
        if rng is None:
            cuts = np.arange(there[0], there[-1])
        else:
            e = edges[f]
            u = rng.uniform(e[there[0]], e[there[-1] - 1]) if there[-1] - 1 > there[0] else e[there[0]]
            cuts = np.clip([np.searchsorted(e, u, "left")], there[0], there[-1] - 1)
        wl, yl = w[cuts], y[cuts]
        wr, yr = w[-1] - wl, y[-1] - yl
        ok = (wl >= least) & (wr >= least) & (wl > 0) & (wr > 0)
        gain = np.where(ok, yl**2 / np.maximum(wl, 1e-300) + yr**2 / np.maximum(wr, 1e-300) - y[-1] ** 2 / w[-1], -np.inf)
        i = int(np.argmax(gain))
        if gain[i] > found[0]:
            found = (float(gain[i]), f, int(cuts[i]), float(wl[i]), float(yl[i]))
    return (*found, varies)


def fit_forest(
    df: DataFrame, key: str, features: str, target: str, n_estimators: int = 100, max_depth: int | None = 10, min_samples_split: int = 2, min_samples_leaf: int = 1,
    max_features="sqrt", bootstrap: bool | None = None, max_samples: float | None = None, extra: bool = False, seed: int = 42, bins: int = BINS,
) -> Forest:
    """A forest of squared error over rows (key, array of features, target); rows with nulls take no part.

    ``extra`` draws cuts at random and takes all rows, unless ``bootstrap``
    says otherwise.  A class of two is a target of 0 and 1: the error is then
    half of Gini's impurity, and the prediction the share of ones.  An empty
    table gives trees that predict 0.
    """
    if not 2 <= bins <= 256:
        raise ValueError(f"bins must be 2 to 256, not {bins}")
    dims = df.agg(F.max(F.size(features))).first()[0] or 0
    edges = edges_of(df, features, dims, bins)
    rows = binned(df, key, features, target, edges)
    draws = (not extra) if bootstrap is None else bootstrap
    rate = float(max_samples or 1)
    want, most = n_candidates(max_features, dims), 10**9 if max_depth is None else max_depth
    spark = df.sparkSession
    trees = [Growing() for _ in range(n_estimators)]
    weights = lambda h, t: poisson_weights(h, t, seed, rate) if draws else np.ones(len(h))

    def totals(batches):
        out = np.zeros((n_estimators, 2))
        for b in batches:
            h, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            for t in range(n_estimators):
                w = weights(h, t)
                out[t] += w.sum(), (w * y).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(n_estimators), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["tree", "w", "s"])

    got = rows.select("h", "y").mapInArrow(totals, "tree int, w double, s double").groupBy("tree").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).collect()
    roots = {r["tree"]: (r["w"], r["s"]) for r in got}
    open_: list[tuple[int, int, float, float, int]] = []  # tree, node, weight, sum, features tried

    def add(t: int, w: float, s: float, depth: int) -> int:
        me = trees[t].node(s / w if w else 0.0, depth)
        if depth < most and w >= max(min_samples_split, 2 * min_samples_leaf) and dims:
            open_.append((t, me, w, s, 0))
        return me

    for t in range(n_estimators):
        add(t, *roots.get(t, (0.0, 0.0)), 0)
    while open_:
        fit = max(1, HISTOGRAM_BYTES // (want * bins * 16))
        now, rest = open_[:fit], open_[fit:]
        open_ = []
        ask: dict[int, dict[int, np.ndarray]] = {}
        for t, n, _, _, tried in now:
            order = np.random.default_rng([seed, t, n]).permutation(dims)
            ask.setdefault(t, {})[n] = order[tried : tried + want]
        lot = spark.sparkContext.broadcast({t: (trees[t].arrays(), nodes) for t, nodes in ask.items()})  # trees and one list a node

        def add_up(batches: Iterator[pa.RecordBatch], lot=lot) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            slots = {t: {n: i for i, n in enumerate(nodes)} for t, (_, nodes) in lot.value.items()}
            for b in batches:
                h, y = b.column(0).to_numpy(), b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(b), dims)
                for t, (arrays, nodes) in lot.value.items():
                    w, at = weights(h, t), at_nodes(arrays, code)
                    place = np.full(len(arrays[0]), -1)
                    place[list(nodes)] = [slots[t][n] for n in nodes]
                    chosen = np.zeros((len(nodes), want), np.int64)
                    for n, fs in nodes.items():
                        chosen[slots[t][n], : len(fs)] = fs
                    live = np.flatnonzero((place[at] >= 0) & (w > 0))
                    if not len(live):
                        continue
                    slot = place[at[live]]
                    cell = (slot[:, None] * want + np.arange(want)) * bins + code[live[:, None], chosen[slot]]
                    size = len(nodes) * want * bins
                    had = sums.setdefault(t, np.zeros((size, 2)))
                    flat = cell.ravel()
                    had[:, 0] += np.bincount(flat, np.repeat(w[live], want), size)
                    had[:, 1] += np.bincount(flat, np.repeat((w * y)[live], want), size)
            for t, s in sums.items():
                nodes = list(lot.value[t][1])
                blobs = [x.tobytes() for x in s.reshape(len(nodes), -1)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array(blobs, pa.binary())], names=["tree", "node", "sums"])

        def choose(batches: Iterator[pa.RecordBatch], lot=lot) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for t, n, blob in zip(*(c.to_pylist() for c in b.columns)):
                    sums[t, n] = sums.get((t, n), 0) + np.frombuffer(blob)
            for (t, n), s in sums.items():
                fs = lot.value[t][1][n]
                rng = np.random.default_rng([seed, t, n, 1]) if extra else None
                found = best_cut(s.reshape(want, bins, 2)[: len(fs)], fs, edges, min_samples_leaf, rng)
                yield pa.RecordBatch.from_pylist([dict(zip(("tree", "node", "gain", "feature", "bin", "w", "s", "varies"), (t, n, *found)))], schema=OUT)

        parts = max(1, min(len(now), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        tables = rows.mapInArrow(add_up, "tree int, node int, sums binary").repartition(parts, "tree", "node")
        cuts = {(r["tree"], r["node"]): r for r in tables.mapInArrow(choose, CUTS).collect()}  # one row a node
        for t, n, w, s, tried in now:
            r = cuts.get((t, n))
            if r is None:
                continue
            if r["feature"] < 0:
                if not r["varies"] and tried + want < dims:  # features that do not vary there do not count
                    open_.append((t, n, w, s, tried + want))
                continue
            tree = trees[t]
            tree.feature[n], tree.bin[n], tree.gain[n] = r["feature"], r["bin"], r["gain"]
            tree.left[n] = add(t, r["w"], r["s"], tree.depth[n] + 1)
            tree.right[n] = add(t, w - r["w"], s - r["s"], tree.depth[n] + 1)
        open_ = rest + open_
    return finished(trees, edges, dims, n_estimators, extra, seed)


CUTS = "tree int, node int, gain double, feature int, bin int, w double, s double, varies boolean"
OUT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()), ("w", pa.float64()), ("s", pa.float64()), ("varies", pa.bool_())])


def finished(trees: list[Growing], edges: list[np.ndarray], dims: int, n: int, extra: bool, seed: int) -> Forest:
    """The forest of the kernels, with thresholds in place of bins."""
    out = Forest(n_estimators=n, extra=extra, seed=seed)
    out.trees, out.p = [], dims
    for g in trees:
        tree = Tree(None, 2, 1, None, extra, "squared_error", None)
        tree.feature, _, tree.left, tree.right = g.arrays()
        tree.value, tree.gain = np.array(g.value), g.gain
        tree.cut = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(g.feature, g.bin)])
        out.trees.append(tree)
    return out


def forest_column(forest: Forest, features: str) -> Column:
    """Predictions of a fitted forest; null where the features hold a null."""

    @F.arrow_udf("double")
    def predict(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return pa.array(forest.predict(x) if len(x) else np.zeros(0))

    x = F.col(features).cast("array<double>")
    whole = F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False))
    filled = F.when(whole, x).otherwise(F.array(*[F.lit(0.0)] * forest.p))
    return F.when(whole, predict(filled))
