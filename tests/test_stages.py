"""Stages of a Pipeline: fitted, stored, read back, applied alike."""
import numpy as np
import pytest
from assayframe.kernels.linear import PLS
from assayframe.plans.stages import Domain, HistogramForest, PlsRegressor, Preprocessor
from pyspark.ml import Pipeline, PipelineModel


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 4)) * [1, 5, 2, 1] + [0, 3, 0, 0]
    y = x[:, 0] - 0.3 * x[:, 1] + 0.1 * rng.normal(size=120)
    data = [(f"c{i}", float(y[i]), *map(float, x[i]), float(x[i, 0] + 1e-3 * rng.normal()), 7.0, None if i % 2 else 1.0) for i in range(120)]
    data[3] = (*data[3][:4], None, *data[3][5:])
    return spark.createDataFrame(data, "compound_id string, activity double, a double, b double, c double, d double, twin double, flat double, sparse double")


COLUMNS = ["a", "b", "c", "d", "twin", "flat", "sparse"]


@pytest.mark.parametrize("regressor", [PlsRegressor(nComponents=3), HistogramForest(nEstimators=4, maxDepth=4)])
def test_a_pipeline_is_stored_and_read_back(spark, rows, tmp_path, regressor):
    pipeline = Pipeline(stages=[Preprocessor(inputCols=COLUMNS), regressor, Domain()])
    pipeline.write().overwrite().save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    back = PipelineModel.load(str(tmp_path / "model"))
    one, two = (m.transform(rows.drop("activity")).orderBy("compound_id").select("compound_id", "features", "predicted", "leverage", "in_domain").collect() for m in (fitted, back))
    assert one == two and len(one) == 120 and {r.in_domain for r in one} <= {True, False}
    assert set(back.stages[0].state.names) in ({"b", "c", "d", "a"}, {"b", "c", "d", "twin"})
    y = np.array([r.activity for r in rows.orderBy("compound_id").collect()])
    assert np.corrcoef(y, [r.predicted for r in one])[0, 1] > 0.85


def test_values_are_those_of_the_plain_fit(rows):
    fitted = Pipeline(stages=[Preprocessor(inputCols=["b", "c"], maxCorr=1.0), PlsRegressor(nComponents=2), Domain()]).fit(rows)
    got = fitted.transform(rows).orderBy("compound_id").toPandas()
    x = got[["b", "c"]].to_numpy(float)
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(np.stack(got["features"]), z)
    assert np.allclose(got["predicted"], PLS(2).fit(z, got["activity"].to_numpy()).predict(z))
    one = np.concatenate((np.ones((120, 1)), z), 1)
    assert np.allclose(got["leverage"], np.einsum("ij,jk,ik->i", one, np.linalg.inv(one.T @ one), one)) and np.allclose(got["h_star"], 9 / 120)
