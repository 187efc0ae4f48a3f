"""Streaming: score new compounds with fitted statistics; watch drift by window."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import to_number


def score_stream(new: DataFrame, fitted: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """(compound_id, predicted) of long-form arrivals by a linear model on z-scores.

    ``fitted`` is the static table of column statistics.  Works on a stream
    (append needs a watermark on ``ts``) and on a table alike.
    """
    weights = fitted.sparkSession.createDataFrame(list(coefficients.items()), "descriptor string, w double")
    stats = fitted.where("reason is null").join(weights, "descriptor").select("descriptor", "median", "mean", "scale", "w")
    z = (F.coalesce("value", "median") - F.col("mean")) / F.col("scale")
    return new.join(F.broadcast(stats), "descriptor").groupBy("compound_id").agg((F.sum(z * F.col("w")) + intercept).alias("predicted"))


def drift(events: DataFrame, ts: str, value: str, mean: float, std: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows: count, mean and its distance from the training mean in standard errors."""
    v = to_number(F.col(value).cast("string"))
    if events.isStreaming:  # watermarks need instants, not wall-clock times
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean_value"))
    z = (F.col("mean_value") - mean) * F.sqrt(F.col("n").cast("double")) / std
    return out.select(F.col("w.start").alias("window_start"), "n", F.round("mean_value", 6).alias("mean_value"), F.round(z, 6).alias("drift_z"))
