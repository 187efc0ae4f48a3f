"""The library's fits as stages of a ``pyspark.ml`` Pipeline, stored and read back with it.

``Preprocessor`` filters, fills and scales columns into an array; ``PlsRegressor``
and ``HistogramForest`` fit a response from the array; ``Domain`` adds leverage
and whether a row lies within h*.  A fitted stage holds arrays alone, written
as one table of named arrays, and reading it runs no stored code.
"""
from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..operators import colstats
from ..operators.domain import augmented_inverse, leverage
from ..operators.forests import fit_forest, forest_column
from ..operators.scalable import Linear, pls_fit
from ..sources.models import SCHEMA, from_rows, to_rows
from ..sources.tables import staged


def number(name: str, text: str, kind=TypeConverters.toFloat) -> Param:
    return Param(Params._dummy(), name, text, typeConverter=kind)


class StateWriter(MLWriter):
    def __init__(self, stage: "Fitted"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.sparkSession.createDataFrame(self.stage.rows(), SCHEMA).coalesce(1).write.parquet(f"{path}/state")


class StateReader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        about = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind()
        stage._resetUid(about["uid"])
        DefaultParamsReader.getAndSetParams(stage, about)
        stage.restore([tuple(r) for r in self.sparkSession.read.parquet(f"{path}/state").collect()])  # one row an array
        return stage


class Fitted(Model, MLWritable, MLReadable):
    """A fitted stage; ``state`` is what it holds: arrays and plain values by name."""

    def __init__(self):
        super().__init__()
        self.state = State()

    def write(self) -> StateWriter:
        return StateWriter(self)

    @classmethod
    def read(cls) -> StateReader:
        return StateReader(cls)

    def rows(self) -> list[tuple]:
        return to_rows(self.state)

    def restore(self, rows: list[tuple]) -> None:
        self.state = State()
        for name, kind, shape, data in rows:
            if kind == "json":
                vars(self.state).update(json.loads(bytes(data)))
            else:
                setattr(self.state, name, np.frombuffer(bytes(data), np.dtype(kind)).reshape(shape))

    def of(self, estimator: Params, **state):
        """This stage with an estimator's parameters and a state."""
        vars(self.state).update(state)
        estimator._copyValues(self)
        return self


class State:
    """Arrays and plain values by name."""


class Fitting(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator whose parameters are keywords of its constructor."""

    defaults: dict = {}

    def __init__(self, **params):
        super().__init__()
        self._setDefault(**self.defaults)
        self._set(**params)


class PreprocessorParams(HasInputCols, HasOutputCol):
    maxMissing = number("maxMissing", "share of missing values above which a column goes")
    minStd = number("minStd", "sample deviation below which a column goes")
    maxCorr = number("maxCorr", "absolute correlation above which one of two columns goes")
    labelCol = number("labelCol", "response that decides which of two correlated columns stays", TypeConverters.toString)


class Preprocessor(Fitting, PreprocessorParams):
    """Column filters, median imputation, z-scores and greedy pruning, fitted on the rows it is given."""

    defaults = {"outputCol": "features", "maxMissing": 0.20, "minStd": 0.01, "maxCorr": 0.95, "labelCol": "activity"}

    def _fit(self, dataset: DataFrame) -> "PreprocessorModel":
        get, columns = self.getOrDefault, self.getInputCols()
        numbered = staged(dataset.select(F.monotonically_increasing_id().alias("__row"), F.col(get("labelCol")).cast("double").alias("__y"), *columns), "stage-input")
        long = colstats.to_long(numbered, "__row", columns)
        fitted = colstats.filter_reasons(long, get("maxMissing"), get("minStd")).where("reason is null").select("descriptor", "median", "mean", "scale")
        found = {r["descriptor"]: (r["median"], r["mean"], r["scale"]) for r in fitted.collect()}  # one row a column
        names = [c for c in columns if c in found]
        model = PreprocessorModel().of(self, names=names, stats=np.array([found[c] for c in names]).reshape(-1, 3))
        if len(names) > 1 and get("maxCorr") < 1:
            vectors = numbered.where("__y is not null").withColumn("__x", model.column())
            corr = colstats.correlation(vectors, "__x", len(names), "__y")
            gone = {n for n, _ in colstats.greedy_prune(corr[:-1, :-1], np.nan_to_num(corr[:-1, -1]), names, get("maxCorr"))}
            keep = [i for i, n in enumerate(names) if n not in gone]
            model.of(self, names=[names[i] for i in keep], stats=model.state.stats[keep])
        return model


class PreprocessorModel(Fitted, PreprocessorParams):
    def column(self) -> Column:
        cells = [(F.coalesce(finite(F.col(f"`{n}`").cast("double")), F.lit(float(m))) - float(a)) / float(s) for n, (m, a, s) in zip(self.state.names, self.state.stats)]
        return F.array(*cells).cast("array<double>")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self.column())


class RegressorParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class PlsRegressor(Fitting, RegressorParams):
    """Partial least squares from cross products."""

    nComponents = number("nComponents", "components at most", TypeConverters.toInt)
    defaults = {"featuresCol": "features", "labelCol": "activity", "predictionCol": "predicted", "nComponents": 10}

    def _fit(self, dataset: DataFrame) -> "PlsRegressorModel":
        rows = dataset.where(F.col(self.getLabelCol()).isNotNull())
        dims = rows.agg(F.max(F.size(self.getFeaturesCol()))).first()[0]
        found = pls_fit(rows, self.getFeaturesCol(), self.getLabelCol(), dims, self.getOrDefault("nComponents"))
        return PlsRegressorModel().of(self, coef=found.coef, intercept=found.intercept)


class PlsRegressorModel(Fitted, RegressorParams):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        linear = Linear(self.state.coef, self.state.intercept, 0)
        return dataset.withColumn(self.getPredictionCol(), linear.column(self.getFeaturesCol()))


class HistogramForest(Fitting, RegressorParams, HasSeed):
    """A random forest, or extremely randomised trees, from histograms; rows are drawn by the key's hash."""

    keyCol = number("keyCol", "column that names a row", TypeConverters.toString)
    nEstimators = number("nEstimators", "trees", TypeConverters.toInt)
    maxDepth = number("maxDepth", "depth of a tree at most", TypeConverters.toInt)
    minLeaf = number("minLeaf", "rows of a leaf at least", TypeConverters.toInt)
    extra = number("extra", "whether cuts are drawn at random", TypeConverters.toBoolean)
    defaults = {"featuresCol": "features", "labelCol": "activity", "predictionCol": "predicted", "keyCol": "compound_id", "nEstimators": 100, "maxDepth": 10, "minLeaf": 1, "extra": False, "seed": 42}

    def _fit(self, dataset: DataFrame) -> "HistogramForestModel":
        get = self.getOrDefault
        forest = fit_forest(
            dataset, get("keyCol"), self.getFeaturesCol(), self.getLabelCol(), get("nEstimators"), get("maxDepth"), min_samples_leaf=get("minLeaf"), extra=get("extra"), seed=self.getSeed()
        )
        out = HistogramForestModel().of(self)
        out.forest = forest
        return out


class HistogramForestModel(Fitted, RegressorParams):
    forest = None

    def rows(self) -> list[tuple]:
        return to_rows(self.forest)

    def restore(self, rows: list[tuple]) -> None:
        self.forest = from_rows("random_forest", rows)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), forest_column(self.forest, self.getFeaturesCol()))


class Domain(Fitting, HasFeaturesCol, HasOutputCol):
    """Leverage of each row against the rows it is fitted on."""

    defaults = {"featuresCol": "features", "outputCol": "in_domain"}

    def _fit(self, dataset: DataFrame) -> "DomainModel":
        features = self.getFeaturesCol()
        dims = dataset.agg(F.max(F.size(features))).first()[0]
        return DomainModel().of(self, inverse=augmented_inverse(dataset, features, dims), n=dataset.count())


class DomainModel(Fitted, HasFeaturesCol, HasOutputCol):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        limit = 3 * len(self.state.inverse) / max(1, self.state.n)
        out = dataset.withColumn("leverage", leverage(self.getFeaturesCol(), self.state.inverse))
        return out.withColumn("h_star", F.lit(limit)).withColumn(self.getOutputCol(), F.col("leverage") <= F.col("h_star"))
