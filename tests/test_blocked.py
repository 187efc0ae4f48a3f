"""Blocked correlation and pruning by rounds against the plain loop."""
import numpy as np
import pytest
from assayframe.operators import blocked, colstats
from assayframe.operators.blocked import prune_correlated, strong_pairs


def columns(d, n=60, seed=1):
    """Families of near copies of all strengths, a constant and two equal columns."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d // 6))
    x = base[:, rng.integers(0, d // 6, d)] + rng.choice([0.05, 0.2, 0.4, 2.0], d) * rng.normal(size=(n, d))
    x[:, 3], x[:, 9] = 5.0, x[:, 8]
    return x * 10 + 100, base[:, 0] + rng.normal(size=n)


@pytest.mark.parametrize("d, block, held", [(50, 512, 1 << 26), (300, 64, 64 * 64 * 8 * 3)])
def test_same_as_one_pair_after_another(spark, monkeypatch, d, block, held):
    monkeypatch.setattr(blocked, "SUMS_BYTES", held)
    x, y = columns(d)
    names = [f"c{i:04d}" for i in np.random.default_rng(2).permutation(d)]
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(3)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(np.c_[x, y].T)
    want = colstats.greedy_prune(np.nan_to_num(r[:d, :d]), np.nan_to_num(r[:d, d]), names, 0.9)
    got = [tuple(t) for t in prune_correlated(df, "x", "y", names, 0.9, block).collect()]
    assert sorted(got) == sorted(want) and len(want) > d // 5
    pairs = strong_pairs(df, "x", "y", names, 0.9, block).collect()
    i, j = np.triu_indices(d, 1)
    strong = np.abs(np.nan_to_num(r[:d, :d])[i, j]) > 0.9
    assert {(p["first"], p["second"]) for p in pairs} == {(names[a], names[b]) for a, b in zip(i[strong], j[strong])}


def test_a_falling_chain(spark):
    """Each pair is weaker than the one before it and shares a column with it."""
    n = 12
    names = [f"n{i:02d}" for i in range(n)]
    rows = [(names[i], names[i + 1], 0.99 - i / 1000, names[i + 1], names[i]) for i in range(n - 1)]
    r = np.eye(n)
    for i, (_, _, s, _, _) in enumerate(rows):
        r[i, i + 1] = r[i + 1, i] = s
    want = colstats.greedy_prune(r, np.zeros(n), names, 0.9)
    got = blocked.pruned(spark.createDataFrame(rows, blocked.PAIRS)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert blocked.pruned(spark.createDataFrame([], blocked.PAIRS)).collect() == []
