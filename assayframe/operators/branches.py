"""Model branches: union, evaluation on the test rows, and the match of the chosen one."""
from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import registry
from .evaluate import regression_metrics
from .search import Training

BRANCH = "branch string, place int, estimator string, is_expansion boolean, params string, features array<string>, status string"


def label(estimator: str, is_expansion: bool) -> str:
    return registry.SLUGS[estimator] + ("_expansion" if is_expansion else "")


def branch_table(spark: SparkSession, branches: list[dict]) -> DataFrame:
    """One row a branch, expansions after the branch they widen."""
    flat = [b for x in branches for b in (x, x.get("expansion")) if b]
    rows = [(label(b["estimator"], b["is_expansion"]), i, b["estimator"], b["is_expansion"], json.dumps(b["params"]), b["features"], b["status"]) for i, b in enumerate(flat)]
    return spark.createDataFrame(rows, BRANCH)


def unique_branches(tables: list[DataFrame], name: str = "branch", order: str = "place") -> DataFrame:
    """Union of branch lists; of one name the row of the first list that has it stays, then the least ``order``."""
    every = tables[0].withColumn("__list", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("__list", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (name, "__list", order)]
    first = every.groupBy(name).agg(F.min(F.struct("__list", order, *rest)).alias("r"))
    return first.select(name, f"r.{order}", *[F.col(f"r.{c}").alias(c) for c in rest])


def branch_predictions(spark: SparkSession, branches: DataFrame, data: Training, wide: DataFrame, key: str = "compound_id", seed: int = 42) -> DataFrame:
    """(branch, key, split, activity, predicted): every branch fitted on the training rows and applied to all.

    Fits are dealt over the cluster, a branch each; the fitted models, one a
    branch, are then sent to the rows.
    """
    from ..sources import models

    lot = spark.sparkContext.broadcast(data)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                at = [lot.value.names.index(n) for n in r.features]
                model = registry.create(r.estimator, json.loads(r.params), seed).fit(lot.value.x[:, at], lot.value.y)
                out += [(r.branch, *row) for row in models.to_rows(model)]
            yield pd.DataFrame(out, columns=["branch", "name", "kind", "shape", "data"])

    rows = branches.collect()
    parts: dict[str, list] = {}
    for r in branches.repartition(max(1, len(rows)), "branch").mapInPandas(fit, f"branch string, {models.SCHEMA}").collect():
        parts.setdefault(r["branch"], []).append(tuple(r)[1:])
    fitted = [(r["branch"], [data.names.index(n) for n in r["features"]], models.from_rows(r["estimator"], parts[r["branch"]])) for r in rows]
    sent = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, 1))
            for name, at, model in sent.value:
                if len(pdf):
                    yield pdf.drop(columns="x").assign(branch=name, predicted=model.predict(x[:, at]))

    ready = wide.select(key, "split", "activity", F.array(*data.names).alias("x"))
    kind = dict(wide.dtypes)[key]
    return ready.mapInPandas(score, f"{key} {kind}, split string, activity double, branch string, predicted double")


def branch_evaluation(predictions: DataFrame, status: Column | None = None) -> DataFrame:
    """One row a branch: train and test figures, and the place by test r2 (acceptable branches first, then the name).

    ``status`` tells from the branch's row whether it is acceptable.
    """
    m = regression_metrics(predictions, ["branch", "split"])
    pick = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    wide = m.groupBy("branch").agg(*[pick(s, c) for s in ("train", "test") for c in ("n", "r2", "rmse", "mae")])
    good = F.coalesce(status, F.lit(False)) if status is not None else F.lit(True)
    order = Window.orderBy(F.desc("acceptable"), F.desc_nulls_last("test_r2"), "branch")  # one row a branch
    return wide.withColumn("acceptable", good).withColumn("place", F.row_number().over(order))


def match_winner(branches: DataFrame, winner: DataFrame) -> DataFrame:
    """The branch that is the winner (estimator, is_expansion, features): by the features in order, else as a set."""
    w = winner.select("estimator", "is_expansion", F.col("features").alias("__w"))
    met = branches.join(w, ["estimator", "is_expansion"]).where(F.array_sort("features") == F.array_sort("__w"))
    exact = F.col("features") == F.col("__w")
    best = met.agg(F.min_by(F.struct("branch", exact.alias("exact")), F.struct(~exact, "branch")).alias("r"))
    return best.where("r is not null").select("r.branch", "r.exact")
