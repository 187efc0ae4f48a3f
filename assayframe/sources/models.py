"""Fitted models as tables: named arrays and plain values in Parquet, read back without running any stored code."""
from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.linear import PLS, SVR
from ..kernels.trees import KNN, Forest, Tree
from ..operators import colstats

CLASSES = {"random_forest": Forest, "extra_trees": Forest, "pls": PLS, "svr": SVR, "knn": KNN}
TREE_PARTS = ("feature", "cut", "left", "right", "value", "gain")
SCHEMA = "name string, kind string, shape array<int>, data binary"


def to_rows(model) -> list[tuple]:
    """(name, kind, shape, data) of everything a fitted model holds."""
    plain, arrays = {}, {}
    for name, value in vars(model).items():
        if name == "trees":
            arrays["trees.size"] = np.array([len(t.value) for t in value], np.int64)
            for part in TREE_PARTS:
                arrays[f"trees.{part}"] = np.concatenate([np.asarray(getattr(t, part)) for t in value])
        elif isinstance(value, np.ndarray):
            arrays[name] = value
        else:
            plain[name] = value.item() if isinstance(value, np.generic) else value
    rows = [(name, a.dtype.str, list(a.shape), bytearray(np.ascontiguousarray(a).tobytes())) for name, a in arrays.items()]
    return [("plain", "json", [], bytearray(json.dumps(plain).encode())), *rows]


def from_rows(estimator: str, rows: list[tuple]):
    model = object.__new__(CLASSES[estimator])
    trees: dict[str, np.ndarray] = {}
    for name, kind, shape, data in rows:
        if kind == "json":
            vars(model).update(json.loads(bytes(data)))
            continue
        value = np.frombuffer(bytes(data), np.dtype(kind)).reshape(shape)
        if name.startswith("trees."):
            trees[name[6:]] = value
        else:
            setattr(model, name, value)
    if trees:
        ends = np.cumsum(trees["size"])
        model.trees = []
        for a, b in zip((ends - trees["size"]).tolist(), ends.tolist()):
            tree = object.__new__(Tree)
            for part in TREE_PARTS:
                setattr(tree, part, trees[part][a:b])
            model.trees.append(tree)
    return model


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text file on whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass
class Scorer:
    """A model with what its inputs need: the fitted statistics, and the descriptors in order."""

    estimator: str
    params: dict
    features: list[str]
    fitted: DataFrame
    model: object

    def vectors(self, long: DataFrame, key: str) -> DataFrame:
        """(key, features) of a long table, aligned with the training descriptors."""
        return colstats.aligned(long, key, self.fitted, self.features)

    def predict(self, vectors: DataFrame, features: str = "features") -> DataFrame:
        """Add ``predicted``; rows are scored a batch at a time where they lie."""
        lot = vectors.sparkSession.sparkContext.broadcast(self.model)

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(lot.value.predict(np.stack(x.to_numpy()).astype(float)))

        return vectors.withColumn("predicted", score(features))


def save(spark: SparkSession, folder: str, scorer: Scorer) -> None:
    spark.createDataFrame(to_rows(scorer.model), SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
    scorer.fitted.coalesce(1).write.mode("overwrite").parquet(f"{folder}/preprocessor")
    write_text(spark, f"{folder}/model.json", json.dumps({"estimator": scorer.estimator, "params": scorer.params, "features": scorer.features}))


def load(spark: SparkSession, folder: str) -> Scorer:
    about = json.loads(read_text(spark, f"{folder}/model.json"))
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/model").collect()]
    return Scorer(about["estimator"], about["params"], about["features"], spark.read.parquet(f"{folder}/preprocessor"), from_rows(about["estimator"], rows))
