"""Neighbour graph, memberships and layout against plain computations."""
import numpy as np
import pytest
from assayframe.operators import manifold, split
from assayframe.operators.manifold import curve, memberships, neighbour_graph, scales, umap_embed
from pyspark.sql import functions as F


def plain_graph(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k], d


def trustworthiness(x, y, k=10):
    """Share of layout neighbours that are neighbours before, by rank."""
    near, _ = plain_graph(y, k)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    rank = np.argsort(np.argsort(d, 1), 1) + 1
    n = len(x)
    lost = sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])
    return 1 - lost * 2 / (n * k * (2 * n - 3 * k - 1))


def points(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def rolled(n, seed=1):
    """A sheet rolled up: its flat neighbours are no neighbours in a projection."""
    rng = np.random.default_rng(seed)
    t = 1.5 * np.pi * (1 + 2 * rng.random(n))
    return np.stack((t * np.cos(t), 12 * rng.random(n), t * np.sin(t)), 1)


def test_graph_of_one_cell_is_exact(spark):
    x = rolled(300)
    near, d = plain_graph(x, 8)
    got = neighbour_graph(points(spark, x), 8).collect()
    assert {(r.u, r.v) for r in got} == {(i, int(j)) for i in range(300) for j in near[i]}
    assert all(abs(r.d - d[r.u, r.v]) < 1e-9 for r in got)


def test_descent_finds_neighbours(spark, monkeypatch):
    monkeypatch.setattr(manifold, "CELL", 64)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 8)) + 4 * rng.integers(0, 4, (1500, 1))
    near, _ = plain_graph(x, 10)
    got = neighbour_graph(points(spark, x), 10).collect()
    assert len(got) == 15_000 and len({(r.u, r.v) for r in got}) == 15_000
    hits = len({(r.u, r.v) for r in got} & {(i, int(j)) for i in range(1500) for j in near[i]})
    assert hits >= 0.95 * 15_000


def test_memberships(spark):
    d = np.sort(np.random.default_rng(3).random((50, 15)), 1)
    w = scales(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-6)
    assert np.allclose(scales(np.zeros((1, 4))), 1)
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 2.0), (1, 0, 1.0), (1, 2, 3.0), (2, 0, 2.0), (2, 1, 3.0)], manifold.EDGES)
    got = {(r.u, r.v): r.w for r in memberships(edges).collect()}
    rows = {i: dict(zip(vs, scales(np.array([ds]))[0])) for i, vs, ds in ((0, (1, 2), (1.0, 2.0)), (1, (0, 2), (1.0, 3.0)), (2, (0, 1), (2.0, 3.0)))}
    assert got.keys() == {(0, 1), (0, 2), (1, 2)}
    assert all(abs(w - (rows[u][v] + rows[v][u] - rows[u][v] * rows[v][u])) < 1e-9 for (u, v), w in got.items())


def test_curve():
    a, b = curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02


@pytest.mark.parametrize("block", [manifold.BLOCK, 120])
def test_layout_keeps_neighbours_better_than_components(spark, monkeypatch, block):
    monkeypatch.setattr(manifold, "BLOCK", block)
    monkeypatch.setattr(manifold, "ROUNDS", 10)
    x = rolled(400)
    df = points(spark, x).withColumnRenamed("x", "features")
    got = umap_embed(df, n_neighbors=12).orderBy("id").toPandas()
    flat = split.embed(df).orderBy("id").toPandas()
    ours, theirs = (trustworthiness(x, np.stack(t["embedding"])) for t in (got, flat))
    assert ours > 0.95 and ours > theirs + 0.02


def test_clusters_come_apart_and_a_seed_repeats(spark):
    rng = np.random.default_rng(4)
    label = np.arange(150) % 3
    x = rng.normal(size=(150, 10)) + 8 * np.eye(10)[label]
    df = points(spark, x).withColumnRenamed("x", "features").coalesce(1)
    y, z = (np.stack(umap_embed(df).orderBy("id").toPandas()["embedding"]) for _ in range(2))
    assert np.array_equal(y, z)
    near, _ = plain_graph(y, 5)
    assert (label[near] == label[:, None]).mean() > 0.98


def test_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(30)] + [(100, None), (101, [None, 1.0]), (102, [float("nan"), 1.0]), (103, [1.0])]
    out = {r.id: r.embedding for r in umap_embed(spark.createDataFrame(rows, "id long, features array<double>"), epochs=5).collect()}
    assert len(out) == 34 and all(out[i] is None for i in (100, 101, 102, 103)) and all(np.isfinite(out[i]).all() and len(out[i]) == 2 for i in range(30))
    for n in (0, 1, 2, 3):
        few = umap_embed(spark.createDataFrame(rows[:n], "id long, features array<double>"), epochs=2).collect()
        assert len(few) == n and all(len(r.embedding) == 2 for r in few)
    assert umap_embed(spark.createDataFrame(rows[:10], "id long, features array<double>").select("features"), epochs=2).columns == ["features", "embedding"]


def test_descent_sends_only_pairs_within_reach():
    """Lists of several points at once: every pair within a point's reach comes with its exact distance, none beyond it."""
    from assayframe.operators.manifold import nearer_pairs

    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 5))
    x[7] = x[3]
    bar = rng.uniform(1, 4, 30)
    bar[4] = np.inf
    lists = {0: [0, 3, 7, 9, 9], 1: [1], 2: [2, 4, 5], 5: [5, 6, 8, 3]}
    at, ids = (np.array(c) for c in zip(*[(a, i) for a, some in lists.items() for i in some]))
    mix = rng.permutation(len(at))
    got = sorted(zip(*(c.tolist() for c in nearer_pairs(at[mix], ids[mix], x[ids[mix]], bar[ids[mix]]))))
    want = []
    for some in lists.values():
        for u in set(some):
            for v in set(some) - {u}:
                d = float(np.sqrt(((x[u] - x[v]) ** 2).sum()))
                if d <= bar[u]:
                    want.append((u, v, d))
    assert got == sorted(want) and (3, 7, 0.0) in got
    assert all(len(c) == 0 for c in nearer_pairs(at[:0], ids[:0], x[:0], bar[:0]))
