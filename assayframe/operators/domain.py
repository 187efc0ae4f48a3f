"""Applicability domain: leverage, standardised residual and Williams classes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .colstats import gramian


def augmented_inverse(train: DataFrame, features: str, dims: int) -> np.ndarray:
    """Pseudo-inverse of the Gramian of (1, x); the rows send one small matrix a task."""
    stats = train.agg(F.count("*").alias("n"), *[F.sum(F.col(features)[i]).alias(f"s{i}") for i in range(dims)]).first()
    n, s = stats["n"], np.array([stats[f"s{i}"] for i in range(dims)], float)
    centred = gramian(train, features, dims)
    g = np.empty((dims + 1, dims + 1))
    g[0, 0], g[0, 1:], g[1:, 0] = n, s, s
    g[1:, 1:] = centred + np.outer(s, s) / max(1, n)
    return np.linalg.pinv(g)


#: descriptors up to which the form is written out as an expression
WRITTEN_OUT = 12


def leverage(features: str, inverse: np.ndarray) -> Column:
    """x M x' of the augmented row: an expression for few descriptors, one product a batch for many."""
    if len(inverse) <= WRITTEN_OUT + 1:
        x = F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"))
        m = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in inverse])
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
        return dot(x, F.transform(m, lambda row: dot(row, x)))

    @F.arrow_udf("double")
    def form(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        x = np.concatenate((np.ones((len(x), 1)), x), 1)
        return pa.array(np.einsum("ij,ij->i", x @ inverse, x))

    return form(F.col(features).cast("array<double>"))


def williams_class(h: Column, limit: Column, residual: Column) -> Column:
    high, out = h > limit, F.abs(residual) > 3
    return F.when(high & out, "outside_both").when(high, "high_leverage").when(out, "response_outlier").otherwise("in_domain")


def applicability(predictions: DataFrame, features: str, dims: int) -> DataFrame:
    """Add residual, leverage, h_star, standardized_residual, applicability_domain, in_domain.

    ``predictions`` has split, activity, predicted and the feature array.  The
    residual scale pools train and test rows; with all residuals 0 it is 0.
    They are written once, since every figure takes a pass.
    """
    predictions = staged(predictions, "domain-rows")
    train = predictions.where("split = 'train'")
    n = train.count()
    inverse = augmented_inverse(train, features, dims)
    limit = 3 * (dims + 1) / n if n else float("nan")
    res = predictions.withColumn("residual", F.col("activity") - F.col("predicted"))
    scale = res.agg(F.sqrt(F.avg(F.col("residual") ** 2))).first()[0] or 0.0
    std = F.col("residual") / scale if scale else F.lit(0.0)
    out = res.withColumn("leverage", leverage(features, inverse)).withColumn("h_star", F.lit(limit)).withColumn("standardized_residual", std)
    kind = williams_class(F.col("leverage"), F.col("h_star"), F.col("standardized_residual"))
    return out.withColumn("applicability_domain", kind).withColumn("in_domain", F.col("applicability_domain") == "in_domain")


def domain_summary(ad: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide(100.0 * F.count_if("in_domain"), F.count("*")), F.lit(0.0))
    return ad.groupBy("split").agg(F.count("*").alias("n"), F.count_if("in_domain").alias("n_in_domain"), F.round(share, 6).alias("pct_in_domain"))


def flagged_ids(ad: DataFrame, key: str = "compound_id") -> DataFrame:
    """Rows outside the domain in any way, with the reason; ordered lists are the reader's sort."""
    return ad.where("not in_domain").select(key, "split", "applicability_domain")
