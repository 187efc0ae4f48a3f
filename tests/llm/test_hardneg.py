"""Hard negatives against a full scan."""
import math

import numpy as np
import pytest
from assayframe.llm import common, hardneg
from assayframe.llm.hardneg import MultiIndex, blocks_of, op11_multi_index_hard_negatives
from assayframe.llm.ivfpq import kmeans

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(good):
        if i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for b, (j, w, m) in enumerate(good) if b != a)
        for score, j, m in [s for s in scored if s[2] == label][:5]:
            fits = [(n, s) for s, n, m in scored if m != label and 30 * -score <= 100 * -s <= 90 * -score]
            out += [(i, j, r + 1, n, -score, -s) for r, (n, s) in enumerate(fits[:10])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def run(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).selectExpr("*", "7 as row", "8 as cell", "9 as block").write.parquet(str(path / "embeddings.parquet"))
    return got(op11_multi_index_hard_negatives(spark, str(path)))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, list(map(float, r.embedding)), r.label) for r in common.table(spark, sf, "embeddings").collect()]
    assert got(op11_multi_index_hard_negatives(spark, sf)) == brute(rows)


def clustered(n, d, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, d))
    at = rng.integers(0, 20, n)
    return (middles[at] + 0.2 * rng.normal(size=(n, d))), at


def test_many_rounds_and_small_blocks(spark, tmp_path, monkeypatch):
    """Budgets and blocks far below the table, so searches go on for several rounds and cells are split."""
    for name, value in (("FIRST_ROWS", 20), ("GROWTH", 2), ("BLOCK", 16), ("ANCHOR_BLOCK", 2)):
        monkeypatch.setattr(hardneg, name, value)
    x, at = clustered(600, 6)
    rows = [(i, [float(v) for v in x[i]], int(at[i]) % 3) for i in range(600)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(100)]  # a group of copies
    assert run(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    one, inf = [0.5, -0.25, 1.0], float("inf")
    rows = [(0, one, 1), (100, [0.0, 0.0, 0.0], 1), (200, [-1.0, 2.0, 0.5], 2), (300, None, 1), (400, [None, 1.0, 1.0], 1), (500, [inf, 1.0, 1.0], 1), (600, [float("nan"), 1.0, 1.0], 1)]
    rows += [(700, one, None), (None, one, 1), (800, [1e5, -3e5, 2e5], 2), (1, one, 1), (1, one, 1), (100, one, 1)]
    rows += [(i, [i / 10, 1 - i / 20, 0.3], i % 3) for i in range(2, 40)]
    rows += [(i, [i * 1e3, 0.7, 0.3], i % 3) for i in range(40, 60)]
    assert run(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2), (3, [0.6], 2)], [(5, [1.0], 1), (6, [1.0], 2)]])
def test_small_tables(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == brute(rows)


def test_heap_gives_falling_bounds_that_hold():
    x, _ = clustered(2000, 8, 3)
    x = np.floor(256 * x).astype(np.int64)
    index = MultiIndex(4, [])
    index.books = [kmeans(h, 12, 8, 1) for h in index.halves(x)]
    cell, far = index.assign(x)
    index.counts = np.bincount(cell, minlength=144)
    index.radii = [np.array([far[k][at == c].max(initial=0) for c in range(12)]) for k, at in enumerate((cell // 12, cell % 12))]
    walk = list(index.falling(x[7]))
    assert [w[0] for w in walk] == sorted((w[0] for w in walk), reverse=True)
    assert sorted(w[2] for w in walk) == sorted(set(cell.tolist()))
    scores = x @ x[7]
    for most, least, c in walk:
        inside = scores[cell == c]
        assert least <= inside.min() and inside.max() <= most


def test_blocks():
    counts = np.array([10, 0, 5000, 4096, 1, 20000, 7])
    first, pieces = blocks_of(counts)
    assert pieces.tolist() == [1, 1, 2, 1, 1, 5, 1]
    spans = [set(range(f, f + p)) for f, p, n in zip(first.tolist(), pieces.tolist(), counts.tolist()) if p > 1]
    assert not set.intersection(*spans) and first[0] not in spans[0]
