"""Linear models fitted from sufficient statistics, whatever the row count."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .colstats import gramian
from .products import pls_coefficients


@dataclass
class Linear:
    coef: np.ndarray
    intercept: float
    n_components: int

    def column(self, features: str) -> Column:
        w = F.array(*[F.lit(float(c)) for c in self.coef])
        return F.aggregate(F.zip_with(F.col(features), w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) + F.lit(self.intercept)


def pls_fit(df: DataFrame, features: str, target: str, dims: int, n_components: int = 10) -> Linear:
    """PLS of one response from X'X and X'y alone.

    Deflating the cross products is the same as deflating the rows, so one
    pass over the table, one small matrix a task, fits the model exactly.
    """
    g = gramian(df, features, dims, extra=target)
    stats = df.agg(F.count("*").alias("n"), F.avg(target).alias("y"), *[F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(dims)]).first()
    mean = np.array([stats[f"m{i}"] for i in range(dims)])
    a, b = g[:dims, :dims].copy(), g[:dims, dims].copy()
    k = max(1, min(n_components, dims, stats["n"] - 1))
    coef = pls_coefficients(a, b, k)
    return Linear(coef, float(stats["y"] - mean @ coef), k)
