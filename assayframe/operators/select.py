"""Model choice: overfitting status, feature count, ranks, final and cross-model choice."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    max_gap: float = 0.15
    severe_gap: float = 0.25
    min_cv: float = 0.50
    max_std: float = 0.15
    min_train: float = 0.40


#: statuses and what they mean, the first that holds; of numbers and of columns alike
STATUSES = (
    ("unstable", lambda train, cv, std, t: std > t.max_std),
    ("underfit", lambda train, cv, std, t: (train < t.min_train) & (cv < t.min_cv)),
    ("overfit", lambda train, cv, std, t: (train - cv > t.max_gap) & (train > t.min_train)),
    ("poor_performance", lambda train, cv, std, t: cv < t.min_cv),
)


def overfit_status(train: Column, cv: Column, std: Column, t: Thresholds = Thresholds()) -> Column:
    """First match wins: unstable, underfit, overfit, poor_performance, good."""
    out = F.lit("good")
    for name, holds in reversed(STATUSES):
        out = F.when(holds(train, cv, std, t), F.lit(name)).otherwise(out)
    return out


def status(train: float, cv: float, std: float, t: Thresholds = Thresholds()) -> str:
    """``overfit_status`` of one candidate's numbers."""
    return next((name for name, holds in STATUSES if holds(train, cv, std, t)), "good")


def assess(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    train, cv, std = (F.col(c) for c in ("mean_train_r2", "mean_cv_r2", "std_cv_r2"))
    status = overfit_status(train, cv, std, t)
    return df.withColumn("status", status).withColumn("acceptable", F.col("status") == "good").withColumn("severe", train - cv > t.severe_gap)


def one_se_count(sfs: DataFrame) -> DataFrame:
    """One row: best_n, threshold (best mean less its deviation) and the least n that reaches it."""
    best = sfs.agg(F.max_by(F.struct("n_features", "mean_cv_r2", "std_cv_r2"), F.struct("mean_cv_r2", -F.col("n_features"))).alias("b"))
    best = best.select(F.col("b.n_features").alias("best_n"), (F.col("b.mean_cv_r2") - F.col("b.std_cv_r2")).alias("threshold"))
    reach = sfs.join(F.broadcast(best), F.col("mean_cv_r2") >= F.col("threshold"))  # best is one row
    return reach.groupBy("best_n", "threshold").agg(F.min("n_features").alias("selected_n"))


def rank_candidates(df: DataFrame, order: str = "candidate_id") -> DataFrame:
    """Add ``rank`` and ``is_best``; the table has one row a candidate of a search, some thousands at most, and is ordered in one task."""
    w = Window.orderBy(F.desc("mean_cv_r2"), order)
    return df.withColumn("rank", F.row_number().over(w)).withColumn("is_best", F.col("rank") == 1)


def select_simplest(df: DataFrame, order: str = "seq") -> DataFrame:
    """The row chosen among acceptable ones (all, if none): within one deviation
    of the greatest mean the least ``simplicity``, the first at a tie.  The
    table has one row a summary of a search: a handful."""
    every = Window.partitionBy()
    pool = df.withColumn("__any", F.max(F.col("acceptable").cast("int")).over(every)).where("acceptable or __any = 0").drop("__any")
    best = F.first(F.struct("mean_cv_r2", "std_cv_r2")).over(every.orderBy(F.desc("mean_cv_r2"), order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = pool.withColumn("__b", best).where("mean_cv_r2 >= __b.mean_cv_r2 - __b.std_cv_r2 - 1e-9").drop("__b")
    return near.orderBy("simplicity", order).limit(1)


# What a parameter adds to an estimator's score, by value where it is a number ("x" times it)
# or by name; "else" is for a value that is not listed, and the last number is that of a missing parameter.
FOREST_TERMS = {
    "max_depth": {"x": 1, None: 50, "missing": None},
    "min_samples_leaf": {"x": -1, "missing": 1},
    "min_samples_split": {"x": -1, "missing": 2},
    "max_features": {"x": 10, "sqrt": 3.0, "log2": 2.5, None: 5.0, "else": 5.0, "missing": "sqrt"},
    "n_estimators": {"x": 0.01, "missing": 100},
}
TERMS = {
    "random_forest": FOREST_TERMS,
    "extra_trees": FOREST_TERMS,
    "pls": {"n_components": {"x": 1, "missing": 10}},
    "svr": {"C": {"x": 1, "missing": 1.0}, "epsilon": {"x": -10, "missing": 0.1}},
    "knn": {"n_neighbors": {"x": 1, "missing": 5}},
}
#: of the share of rows that a forest's bootstrap leaves out
LEFT_OUT = 5


def simplicity(estimator: str, p: dict) -> float:
    """Lower is preferred; only comparable within one estimator."""
    total = 0.0
    for name, term in TERMS[estimator].items():
        value = p.get(name, term["missing"])
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        total += term["x"] * value if number else term.get(value, term.get("else", 0.0))
    if TERMS[estimator] is FOREST_TERMS and p.get("bootstrap", True):
        total += LEFT_OUT * (1 - (p.get("max_samples") or 1))
    return float(total)


def stop_search(summary: dict, baseline_cv: float, status: str, t: Thresholds = Thresholds(), least_gain: float = 0.02) -> bool:
    if status == "good":
        return True
    gained = summary["mean_cv_r2"] - baseline_cv >= least_gain
    return gained and summary["gap"] <= t.max_gap and summary["std_cv_r2"] <= t.max_std and status != "overfit"
