"""Forests from histograms against the exact kernel."""
import numpy as np
import pytest
from assayframe.kernels.trees import Forest
from assayframe.operators import forests
from assayframe.operators.forests import edges_of, fit_forest, forest_column, poisson_weights
from pyspark.sql import functions as F


def table(n=300, seed=1):
    """Values of few kinds, so that every value has a bin."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 4)).astype(float) * [1, 0.5, -2, 10]
    y = np.sin(x[:, 0]) + (x[:, 1] > 4) * x[:, 2] / 10 + 0.1 * rng.normal(size=n)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y double").repartition(4)


def predicted(df, forest):
    return np.array([r.p for r in df.withColumn("p", forest_column(forest, "x")).orderBy("id").collect()])


@pytest.mark.parametrize("args", [{"max_depth": 4}, {"max_depth": None, "min_samples_leaf": 5}, {"max_depth": 6, "min_samples_split": 30}])
def test_one_tree_is_that_of_the_kernel(spark, args):
    x, y = table()
    want = Forest(n_estimators=1, max_features=None, bootstrap=False, **args).fit(x, y)
    got = fit_forest(frame(spark, x, y), "id", "x", "y", n_estimators=1, max_features=None, bootstrap=False, **args)
    assert np.allclose(predicted(frame(spark, x, y), got), want.predict(x), atol=1e-9)
    assert np.allclose(got.importances(), want.importances(), atol=1e-9)


def test_forests_predict_like_the_kernel(spark, monkeypatch):
    """Held-out error of whole forests, with a histogram that takes several passes a level."""
    monkeypatch.setattr(forests, "HISTOGRAM_BYTES", 20 * 2 * 64 * 16)
    x, y = table(500)
    df = frame(spark, x[:400], y[:400])
    for extra in (False, True):
        ours = fit_forest(df, "id", "x", "y", n_estimators=12, max_depth=6, extra=extra)
        kernel = Forest(n_estimators=12, max_depth=6, extra=extra).fit(x[:400], y[:400])
        error = [np.sqrt(((f.predict(x[400:]) - y[400:]) ** 2).mean()) for f in (ours, kernel)]
        assert error[0] < 1.25 * error[1] and error[0] < 0.8 * y[400:].std()
        assert len(ours.trees) == 12 and abs(ours.importances().sum() - 1) < 1e-9
        again = fit_forest(df.repartition(7), "id", "x", "y", n_estimators=2, max_depth=3, extra=extra)
        same = fit_forest(df.repartition(2), "id", "x", "y", n_estimators=2, max_depth=3, extra=extra)
        assert np.allclose(again.predict(x), same.predict(x))


def test_weights_are_poisson_and_repeat():
    h = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 200_000)
    w = poisson_weights(h, 3, 42, 1.0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert np.array_equal(w, poisson_weights(h, 3, 42, 1.0)) and not np.array_equal(w, poisson_weights(h, 4, 42, 1.0))
    assert abs(poisson_weights(h, 3, 42, 0.5).mean() - 0.5) < 0.01


def test_bins_at_quantiles_of_many_values(spark):
    df = spark.range(5000).select("id", F.array((F.col("id") * 7919 % 5000).cast("double"), F.lit(3.0)).alias("x"))
    edges = edges_of(df, "x", 2, 16)
    assert len(edges[0]) == 15 and np.allclose(np.diff(edges[0]), 312.5, atol=3) and len(edges[1]) == 0


def test_odd_rows(spark):
    rows = [(i, [1.0, float(i % 3)], float(i % 3)) for i in range(60)] + [(100, None, 1.0), (101, [None, 1.0], 1.0), (102, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double")
    forest = fit_forest(df, "id", "x", "y", n_estimators=3, max_features=1)  # the first feature never varies
    got = {r.id: r.p for r in df.withColumn("p", forest_column(forest, "x")).collect()}
    assert got[100] is None and got[101] is None and all(abs(got[i] - i % 3) < 0.5 for i in range(60))
    empty = fit_forest(df.limit(0), "id", "x", "y", n_estimators=2)
    assert [len(t.value) for t in empty.trees] == [1, 1]
