"""Tables behind the seven figures; rendering is left to the reader."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plot_split(df: DataFrame) -> DataFrame:
    return df.select(F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"), "cluster", "split")


def plot_sfs(sfs: DataFrame, selected: int) -> DataFrame:
    return sfs.select("n_features", "mean_train_r2", "mean_cv_r2", "std_cv_r2", (F.col("n_features") == selected).alias("selected"))


def plot_ga(history: DataFrame) -> DataFrame:
    return history.select("generation", "best_fitness", "avg_fitness")


def plot_round(candidates: DataFrame) -> DataFrame:
    return candidates.select("rank", "mean_train_r2", "mean_cv_r2", "std_cv_r2", "is_best")


def plot_rounds(rounds: DataFrame) -> DataFrame:
    return rounds.select("source", "mean_train_r2", "mean_cv_r2", "std_cv_r2", "selected")


def plot_scatter(predictions: DataFrame) -> DataFrame:
    """Points with the limits of the 1:1 line, 5 % beyond the data."""
    ends = predictions.agg(F.least(F.min("activity"), F.min("predicted")).alias("lo"), F.greatest(F.max("activity"), F.max("predicted")).alias("hi"))
    margin = 0.05 * (F.col("hi") - F.col("lo"))
    limits = ends.select((F.col("lo") - margin).alias("axis_min"), (F.col("hi") + margin).alias("axis_max"))
    return predictions.select("split", "activity", "predicted").join(F.broadcast(limits))  # limits is one row


def plot_williams(ad: DataFrame) -> DataFrame:
    return ad.select("leverage", "standardized_residual", "split", "h_star", F.lit(3.0).alias("limit"))
