"""Regression and classification metrics, fold metrics and their summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running_before


def regression_metrics(df: DataFrame, by: list[str], y: str = "activity", p: str = "predicted") -> DataFrame:
    """n, r2, rmse, mae by group in one pass: the squares about the group's mean are its moment; a null group is one."""
    e = F.col(y) - F.col(p)
    total = F.var_pop(y) * F.count(y)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
    )


def cv_summary(folds: DataFrame, by: list[str]) -> DataFrame:
    """Mean train and validation r2, population deviation of the latter, and the gap."""
    return folds.groupBy(*by).agg(
        F.avg("train_r2").alias("mean_train_r2"), F.avg("val_r2").alias("mean_cv_r2"), F.stddev_pop("val_r2").alias("std_cv_r2"),
    ).withColumn("gap", F.col("mean_train_r2") - F.col("mean_cv_r2"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    def cell(a: int, b: int) -> Column:
        return F.count_if((F.col(y) == a) & (F.col(p) == b))

    return df.agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision, recall, F1, MCC, accuracy, specificity; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return confusion(df, y, p).select(
        "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp * tn - fp * fn, root).alias("mcc"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tn, tn + fp).alias("specificity"),
    )


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Rank-sum AUC with midranks: distinct scores are counted first, then cumulated part by part."""
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n"))
    below = running_before(per, "s", ["n"])
    return below.agg(F.try_divide(F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))
