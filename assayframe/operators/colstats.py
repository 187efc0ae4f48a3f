"""Column filters, imputation, correlation and scaling over a long matrix.

The long form (compound_id, descriptor, value) scales in rows and columns
alike: every statistic is one grouped aggregate with map-side partials.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.tables import staged
from .ranks import exact_median, with_groups


def to_long(wide: DataFrame, key: str, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Unpivot numeric columns; non-finite values become null and stay as rows.  ``keep`` names columns to repeat beside the key."""
    pairs = F.array(*[F.struct(F.lit(c).alias("descriptor"), finite(F.col(c).cast("double")).alias("value")) for c in columns])
    return wide.select(key, *keep, F.explode(pairs).alias("d")).select(key, *keep, "d.descriptor", "d.value")


def vector_to_long(df: DataFrame, key: str, vector: str, prefix: str = "d") -> DataFrame:
    exploded = df.select(key, F.posexplode(vector).alias("i", "v"))
    return exploded.select(key, F.concat(F.lit(prefix), F.lpad(F.col("i").cast("string"), 3, "0")).alias("descriptor"), finite(F.col("v").cast("double")).alias("value"))


def medians(long: DataFrame) -> DataFrame:
    """Exact median, present and missing counts of each descriptor."""
    counts = long.groupBy("descriptor").agg(F.count("*").alias("n"), F.count("value").alias("present"))
    return counts.join(exact_median(long, ["descriptor"], "value"), "descriptor", "left")


def impute(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fill nulls with the fitted median; descriptors not fitted go, missing ones do not come."""
    return with_groups(long, fitted.select("descriptor", "median"), ["descriptor"]).withColumn("value", F.coalesce("value", "median")).drop("median")


def spread(long: DataFrame) -> DataFrame:
    """Sample and population deviation and mean."""
    v = F.col("value")
    return long.groupBy("descriptor").agg(F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("scale"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))


def filter_reasons(train: DataFrame, max_missing: float = 0.20, min_std: float = 0.01) -> DataFrame:
    """(descriptor, n, present, median, std, scale, mean, reason); reason is null for those kept.

    In order: nonnumeric (no value at all), missing share above the limit,
    constant, and sample deviation under the limit, after imputation.
    """
    base = staged(medians(train), "medians")
    stats = spread(impute(train, base))
    missing = 1 - F.col("present") / F.col("n")
    reason = (
        F.when(F.col("present") == 0, F.lit("nonnumeric"))
        .when(missing > max_missing, F.lit(f"missing>{max_missing:g}"))
        .when((F.col("std") == 0) | (F.col("low") == F.col("high")), F.lit("constant"))
        .when(F.col("std") < min_std, F.lit(f"near_constant_std<{min_std:g}"))
    )
    return base.join(stats, "descriptor", "left").withColumn("reason", reason).drop("low", "high")


REASONS = ("nonnumeric", "missing", "constant", "near_constant", "correlated")


def reason_bucket(reason: Column) -> Column:
    out = F.when(reason.startswith("near_constant"), F.lit("near_constant"))
    for name in ("nonnumeric", "missing", "constant", "correlated"):
        out = out.when(reason.startswith(name), F.lit(name))
    return out


def reason_counts(removed: DataFrame) -> DataFrame:
    """Counts of the five buckets, zeros included."""
    spark = removed.sparkSession
    found = removed.where("reason is not null").groupBy(reason_bucket(F.col("reason")).alias("bucket")).count()
    names = spark.createDataFrame([(r,) for r in REASONS], "bucket string")
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).cast("long").alias("n_removed"))


def zscore(long: DataFrame, fitted: DataFrame) -> DataFrame:
    """Train-fitted imputation and scaling, applied to any rows."""
    stats = fitted.where("reason is null").select("descriptor", "median", "mean", "scale")
    return with_groups(long, stats, ["descriptor"]).withColumn("value", (F.coalesce("value", "median") - F.col("mean")) / F.col("scale")).drop("median", "mean", "scale")


def to_vectors(long: DataFrame, key: str) -> DataFrame:
    """(key, features) in descriptor order; the vector of one row is the group.  Every key must have every descriptor."""
    pairs = F.array_sort(F.collect_list(F.struct("descriptor", "value")))
    return long.groupBy(key).agg(pairs.alias("p")).select(key, F.col("p.value").alias("features"))


def aligned(long: DataFrame, key: str, fitted: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(key, features): scaled values in the fitted order, whatever descriptors the rows of ``long`` have.

    Descriptors not fitted go; a fitted one that a key lacks, or has as null,
    counts as its median, scaled like a value.  The fitted list is one row a
    descriptor; ``names`` picks from it and gives the order.
    """
    rows = fitted.where("reason is null").select("descriptor", "median", "mean", "scale").collect()
    fill = {r["descriptor"]: (r["median"] - r["mean"]) / r["scale"] for r in rows}
    names = sorted(fill) if names is None else names
    default = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(float(fill[n])) for n in names]))
    scaled = zscore(long, fitted).where(F.col("descriptor").isin(names) if len(names) < 100 else F.map_contains_key(default, F.col("descriptor")))
    have = scaled.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("descriptor", "value"))).alias("m"))
    every = long.select(key).distinct().join(have, key, "left")
    value = lambda n: F.coalesce(F.try_element_at("m", n), F.element_at(default, n))
    return every.select(key, F.transform(F.array(*map(F.lit, names)), value).alias("features"))


def gramian(vectors: DataFrame, features: str, dims: int, extra: str | None = None) -> np.ndarray:
    """Sum of outer products of the rows, centred on the means first.

    Each task sums its rows to one matrix of dims x dims, whatever their
    number, and deals its rows out; the matrices are added where they meet,
    and one of them comes to the driver.
    """
    cols = [F.col(features)[i] for i in range(dims)] + ([F.col(extra)] if extra else [])
    flat = vectors.select(F.array(*[c.cast("double") for c in cols]).alias("x"))
    d = len(cols)
    means = np.array([x or 0.0 for x in flat.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).first()])
    slices = min(d, 16)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - means
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([total[i::slices].tobytes() for i in range(slices)], pa.binary())], names=["slice", "g"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(g)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([g.tobytes() for g in sums.values()], pa.binary())], names=["slice", "g"])

    out = np.zeros((d, d))
    for r in flat.mapInArrow(add, "slice int, g binary").repartition(slices, "slice").mapInArrow(join, "slice int, g binary").collect():
        out[r["slice"] :: slices] += np.frombuffer(r["g"]).reshape(-1, d)
    return out


def correlation(vectors: DataFrame, features: str, dims: int, extra: str | None = None) -> np.ndarray:
    g = gramian(vectors, features, dims, extra)
    s = np.sqrt(np.diag(g))
    s[s == 0] = np.nan
    return g / np.outer(s, s)


def corr_pairs(spark, r: np.ndarray, names: list[str], least: float = -1.0) -> DataFrame:
    """(first, second, r) of the upper triangle, first before second in column order."""
    i, j = np.triu_indices(len(names), 1)
    keep = np.abs(r[i, j]) > least
    rows = [(names[a], names[b], float(r[a, b])) for a, b in zip(i[keep], j[keep])]
    return spark.createDataFrame(rows, "first string, second string, r double")


def greedy_prune(r: np.ndarray, with_target: np.ndarray, names: list[str], limit: float = 0.95) -> list[tuple[str, str]]:
    """(dropped, because of) by descending correlation; the one nearer the target stays.

    A pair is passed over once either side is gone; at a tie the
    lexicographically larger name goes.
    """
    i, j = np.triu_indices(len(names), 1)
    a = np.abs(r[i, j])
    pairs = sorted((-x, names[p], names[q], p, q) for x, p, q in zip(a, i, j) if x > limit)
    gone: dict[str, str] = {}
    for _, first, second, p, q in pairs:
        if first in gone or second in gone:
            continue
        tp, tq = abs(with_target[p]), abs(with_target[q])
        lose, win = (first, second) if tp < tq else (second, first) if tq < tp else (max(first, second), min(first, second))
        gone[lose] = win
    return list(gone.items())


def simple_prune(r: np.ndarray, names: list[str], limit: float) -> list[str]:
    """Later columns whose signed correlation with any earlier one passes the limit."""
    return [n for k, n in enumerate(names) if k and np.nanmax(r[:k, k]) > limit]
