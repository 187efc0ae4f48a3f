"""Minority oversampling by interpolation between near neighbours."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def oversample(df: DataFrame, key: str, features: str, label: str, minority: int, k: int = 3, seed: int = 42, block: int = 2048) -> DataFrame:
    """Rows (features, synthetic) with the minority raised to the majority's count.

    Minority rows are dealt into blocks by hash.  Every block meets every other
    and passes on each row's k nearest in it, ties to the smaller (block,
    place), so a task holds two blocks and the neighbours are those of the
    whole minority.  Each row makes its share of new points at seeded places
    on the lines to its neighbours.
    """
    n = df.groupBy((F.col(label) == minority).alias("m")).count().collect()
    size = {r["m"]: r["count"] for r in n}
    few, many = size.get(True, 0), size.get(False, 0)
    real = df.select(F.col(features).alias("features"), F.lit(False).alias("synthetic"))
    if few < 2 or few >= many:
        return real
    share, extra = divmod(many - few, few)
    blocks = -(-few // block)
    w = Window.partitionBy("b").orderBy(F.xxhash64(F.lit(seed), key), key)
    small = df.where(F.col(label) == minority).select(key, F.col(features).alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    small = small.withColumn("place", F.row_number().over(w))

    small = small.select("x", "b", "place")
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = small.withColumn("g", others)
    gives = small.withColumnRenamed("b", "g").withColumn("b", others)

    def near(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"b": [], "place": [], "tb": [], "tplace": [], "d": []})
        c = c.sort_values("place")
        x, at = np.stack(c["x"]).astype(float), c["place"].to_numpy()
        b, g = int(a["b"].iloc[0]), int(c["g"].iloc[0])
        places, points = a["place"].to_numpy(), np.stack(a["x"]).astype(float)
        few, some, out = min(k, len(x) - (b == g)), max(1, (1 << 22) // max(1, x.size)), []
        for s in range(0, len(points), some):  # a block of points meets the whole block at once
            d = ((x[None] - points[s : s + some, None]) ** 2).sum(2)
            if b == g:
                d[places[s : s + some, None] == at[None]] = np.inf
            top = np.argsort(d, 1, kind="stable")[:, :few]
            row = np.repeat(places[s : s + some], few)
            out.append(pd.DataFrame({"b": b, "place": row, "tb": g, "tplace": at[top].ravel(), "d": np.take_along_axis(d, top, 1).ravel()}))
        return pd.concat(out)

    met = asks.groupBy("b", "g").cogroup(gives.groupBy("b", "g")).applyInPandas(near, "b int, place int, tb int, tplace int, d double")
    rank = F.row_number().over(Window.partitionBy("b", "place").orderBy("d", "tb", "tplace"))
    top = met.withColumn("r", rank).where(F.col("r") <= k)
    ends = small.select(F.col("b").alias("tb"), F.col("place").alias("tplace"), F.col("x").alias("tx"))
    ties = top.join(ends, ["tb", "tplace"]).groupBy("b", "place").agg(F.array_sort(F.collect_list(F.struct("r", "tx"))).alias("near"))
    quota, before = {}, 0  # rows of each block that make one point more: ``extra`` in all
    for r in small.groupBy("b").count().orderBy("b").collect():
        quota[r["b"]] = (before + r["count"]) * extra // few - before * extra // few
        before += r["count"]

    def make(batches):
        for pdf in batches:
            out = []
            for b, p, x, near in zip(pdf["b"], pdf["place"], pdf["x"], pdf["near"]):
                rng = np.random.default_rng([seed, b, p])
                x = np.asarray(x, float)
                for _ in range(share + (p <= quota[b])):
                    to = np.asarray(near[rng.integers(len(near))]["tx"], float)
                    out.append((x + rng.random() * (to - x)).tolist())
            yield pd.DataFrame({"features": out, "synthetic": True})

    made = small.join(ties, ["b", "place"]).mapInPandas(make, "features array<double>, synthetic boolean")
    return real.unionByName(made)
