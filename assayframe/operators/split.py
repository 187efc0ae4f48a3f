"""Cluster-aware train/test split, folds, embedding and choice of k."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from .ranks import first_share, running_before


def shuffled(seed: int, key: str) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def divided(df: DataFrame, key: str, by: list[str], share: float, seed: int, least: int) -> DataFrame:
    """Add ``split``: of each group of more than ``least`` rows the first ceil(share n) in seeded order are test."""
    code = F.conv(F.substring(shuffled(seed, key), 1, 13), 16, 10).cast("long")  # the order of the whole hash, but for ties; exact as a double
    placed = first_share(df.withColumn("__md5", shuffled(seed, key)), by, code, ["__md5", key], share)
    return placed.withColumn("split", F.when((F.col("n") > least) & F.col("first"), F.lit("test")).otherwise(F.lit("train"))).drop("n", "first", "__md5")


def stratified_split(df: DataFrame, key: str, cluster: str = "cluster", fraction: float = 0.20, seed: int = 42, least: int = 5) -> DataFrame:
    """Add ``split``: per cluster the first ceil(fraction n) rows in seeded order are test.

    Clusters of ``least`` rows or fewer are all train.  If none is test, the
    whole table is split with max(fraction, 1/n).
    """
    out = divided(df, key, [cluster], fraction, seed, least)
    got = out.agg(F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")).first()
    if got["n"] < 2:
        raise ValueError("a split needs at least two rows")
    if got["t"]:
        return out
    return divided(df.withColumn("__all", F.lit(1)), key, ["__all"], max(fraction, 1 / got["n"]), seed, 0).drop("__all")


def cluster_tables(df: DataFrame, key: str, cluster: str = "cluster", fraction: float = 0.20, seed: int = 42, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, test) with all columns: the stratified split without its fallback, so small tables may have no test rows.

    Clusters of ``least`` rows or fewer are all train; a null cluster is one.
    """
    placed = divided(df, key, [cluster], fraction, seed, least)
    return tuple(placed.where(F.col("split") == part).drop("split") for part in ("train", "test"))


def check_split(df: DataFrame, key: str) -> None:
    both = df.groupBy(key).agg(F.countDistinct("split").alias("n")).where("n > 1")
    if not both.isEmpty():
        raise ValueError("train and test share ids")
    if df.where("split = 'test'").isEmpty():
        raise ValueError("empty test set")


def split_stats(df: DataFrame, activity: str = "activity") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg(activity), 6).alias("mean_activity"), F.round(F.stddev_samp(activity), 6).alias("std_activity"))


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int | None = 42) -> DataFrame:
    """Add ``fold`` 0..k-1 by a seeded hash of the key, or contiguous by key order.

    The seeded form is row-wise: no global sort, folds equal in expectation.
    The contiguous one takes keys that do not repeat.
    """
    if seed is not None:
        code = F.conv(F.substring(shuffled(seed, key), 1, 8), 16, 10).cast("long")
        return df.withColumn("fold", F.pmod(code, F.lit(k)).cast("int"))
    n = df.count()
    small, large = divmod(n, k)  # the first ``large`` folds have one row more
    placed = running_before(df.withColumn("__one", F.lit(1).cast("long")), key, ["__one"])
    at, edge = F.col("__one_before"), large * (small + 1)
    fold = F.when(at < edge, F.floor(at / (small + 1))).otherwise(large + F.floor((at - edge) / max(1, small)))
    return placed.withColumn("fold", fold.cast("int")).drop("__one", "__one_before")


def permuted_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1: rows in key order are dealt by a seeded permutation, so folds differ by one row at most.

    The folds are those of a search on rows; a byte a row is sent to the tasks.
    """
    n = df.count()
    deal = np.empty(n, np.int8)
    deal[np.random.default_rng(seed).permutation(n)] = np.arange(n) % k
    lot = df.sparkSession.sparkContext.broadcast(deal)

    @F.arrow_udf("int")
    def dealt(place: pa.Array) -> pa.Array:
        return pa.array(lot.value[place.to_numpy(zero_copy_only=False)].astype(np.int32))

    placed = running_before(df.withColumn("__one", F.lit(1).cast("long")), key, ["__one"])
    return placed.withColumn("fold", dealt("__one_before")).drop("__one", "__one_before")


def embed(vectors: DataFrame, features: str = "features", dims: int = 2) -> DataFrame:
    """Principal components as the embedding."""
    frame = vectors.withColumn("__v", array_to_vector(features))
    model = PCA(k=dims, inputCol="__v", outputCol="__e").fit(frame)
    return model.transform(frame).withColumn("embedding", vector_to_array("__e")).drop("__v", "__e")


def cluster(embedded: DataFrame, k: int, seed: int = 60) -> DataFrame:
    frame = embedded.withColumn("__v", array_to_vector("embedding"))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(frame)
    return model.transform(frame).drop("__v")


def centroids(df: DataFrame, point: str = "embedding", label: str = "cluster") -> DataFrame:
    """(label, i, c, n): coordinates of each cluster's mean."""
    rows = df.select(label, F.posexplode(point).alias("i", "v"))
    return rows.groupBy(label, "i").agg(F.avg("v").alias("c"), F.count("*").alias("n"))


def davies_bouldin(df: DataFrame, key: str, point: str = "embedding", label: str = "cluster") -> float:
    """Mean over clusters of the worst (scatter_i + scatter_j) / distance; k is small."""
    c = centroids(df, point, label)
    off = (
        df.select(key, label, F.posexplode(point).alias("i", "v")).join(F.broadcast(c), [label, "i"])  # the centroids come to the driver below as well
        .groupBy(key, label).agg(F.sqrt(F.sum((F.col("v") - F.col("c")) ** 2)).alias("d")).groupBy(label).agg(F.avg("d").alias("s"))
    )
    scatter = {r[label]: r["s"] for r in off.collect()}
    center: dict = {}
    for r in c.collect():
        center.setdefault(r[label], {})[r["i"]] = r["c"]
    point_of = {k: np.array([v[i] for i in sorted(v)]) for k, v in center.items()}
    worst = [max(((scatter[a] + scatter[b]) / d if (d := np.linalg.norm(point_of[a] - point_of[b])) else np.inf) for b in point_of if b != a) for a in point_of]
    return float(np.mean(worst))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by one matrix product; close pairs, where that would cancel, by their differences."""
    own, other = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    d = x @ y.T
    d *= -2
    d += own
    d += other
    close = d < 1e-5 * (own + other) if not d.min() >= 1e-5 * (own.max() + other.max()) else None
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    if close is not None:
        near = np.flatnonzero(close)
        for a in range(0, len(near), 1 << 13):
            i, j = np.divmod(near[a : a + (1 << 13)], len(y))
            gap = x[i] - y[j]
            d[i, j] = np.sqrt((gap * gap).sum(1))
    return d


def silhouette(df: DataFrame, key: str, point: str = "embedding", label: str = "cluster", block: int = 32768) -> DataFrame:
    """(key, label, silhouette) with Euclidean distances, exact.

    Points are dealt into blocks; each two blocks meet in one task, which
    serves the points of both.  A task holds two blocks, their sums by cluster
    and the distances of a few of their rows, never the table; many clusters
    make blocks smaller.  The work is quadratic all the same.
    """
    head = df.agg(F.count("*"), F.approx_count_distinct(label)).first()
    n, block = head[0], int(np.clip((1 << 21) // max(1, head[1]), min(1024, block), block))
    blocks = max(1, -(-n // block), min(16, -(-n // 2048)))
    kind = dict(df.dtypes)
    dealt = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(point).alias("x")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = staged(dealt, "silhouette-blocks")
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.select(F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"), (F.col("b") <= F.col("other")).alias("first"), "id", "label", "x")

    def places(labels: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        coded = labels.combine_chunks().dictionary_encode(null_encoding="encode")
        return coded.dictionary, coded.indices.to_numpy()

    def meet(pair: tuple, t: pa.Table) -> pa.Table:
        p, q = (v.as_py() for v in pair)
        first = t.column("first").to_numpy()
        left = t if p == q else t.filter(pa.array(first))
        right = t if p == q else t.filter(pa.array(~first))
        schema = pa.schema([t.schema.field("id"), t.schema.field("label"), ("to", t.schema.field("label").type), ("s", pa.float64()), ("n", pa.int64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        x, y = (np.asarray(s.column("x").combine_chunks().flatten(), float).reshape(len(s), -1) for s in (left, right))
        x, y = x - x[0], y - x[0]  # nearer the origin less is lost
        (names, at), (others, to) = places(left.column("label")), places(right.column("label"))
        across, down = np.argsort(to, kind="stable"), np.argsort(at, kind="stable")
        x, at, left = x[down], at[down], left.take(pa.array(down))
        y, to, right = y[across], to[across], right.take(pa.array(across))
        here, there = np.zeros((len(x), len(others))), np.zeros((len(names), len(y)))
        for c in range(0, len(y), 8192):  # pieces that stay in a core's cache
            columns, from_column = np.unique(to[c : c + 8192], return_index=True)
            for a in range(0, len(x), 32):
                d = distances(x[a : a + 32], y[c : c + 8192])
                here[a : a + 32, columns] += np.add.reduceat(d, from_column, 1)
                if p != q:
                    rows, from_row = np.unique(at[a : a + 32], return_index=True)
                    there[rows, c : c + 8192] += np.add.reduceat(d, from_row, 0)
        out = []
        both = ((left, here.T, others, np.bincount(to, minlength=len(others))), (right, there, names, np.bincount(at, minlength=len(names))))
        for of, values, labels, counts in both[: 1 if p == q else 2]:
            for c in range(len(labels)):
                to_all = labels.take(pa.array(np.full(len(of), c)))
                out.append(pa.table([of.column("id"), of.column("label"), to_all, pa.array(values[c]), pa.array(np.full(len(of), counts[c]))], schema=schema))
        return pa.concat_tables(out)

    schema = f"id {kind[key]}, label {kind[label]}, to {kind[label]}, s double, n long"
    met = met.groupBy("p", "q").applyInArrow(meet, schema)
    mean = met.groupBy("id", "label", "to").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.max(F.when(F.col("to") == F.col("label"), F.try_divide("s", F.col("n") - 1)))
    alone = F.max(F.when(F.col("to") == F.col("label"), F.col("n"))) == 1
    near = F.min(F.when(F.col("to") != F.col("label"), F.col("s") / F.col("n")))
    per = mean.groupBy("id", "label").agg(own.alias("a"), near.alias("b"), alone.alias("alone"))
    value = F.when(F.col("alone") | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(F.col("id").alias(key), F.col("label").alias(label), value.alias("silhouette"))


def mean_silhouette(df: DataFrame, point: str = "embedding", label: str = "cluster") -> float:
    """Mean silhouette with squared distances, from sums by cluster: one pass, whatever the row count."""
    frame = df.select(array_to_vector(point).alias("v"), F.col(label).cast("double").alias("c"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="c", distanceMeasure="squaredEuclidean").evaluate(frame)


def choose_k(embedded: DataFrame, key: str, least: int = 2, most: int = 10, seed: int = 60, exact: bool = False) -> tuple[int, dict[int, float]]:
    """k with the greatest silhouette minus Davies-Bouldin, the first at a tie.

    The silhouette is that of squared distances; ``exact`` asks for plain
    distances between all pairs of points, for tables of some ten thousand.
    """
    scores: dict[int, float] = {}
    for k in range(least, most + 1):
        labelled = cluster(embedded, k, seed)
        if labelled.select("cluster").distinct().count() < 2:
            continue
        mean = silhouette(labelled, key).agg(F.avg("silhouette")).first()[0] if exact else mean_silhouette(labelled)
        scores[k] = mean - davies_bouldin(labelled, key)
    return (max(scores, key=lambda k: (scores[k], -k)) if scores else least), scores
