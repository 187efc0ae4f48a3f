"""Hilbert-curve sharding of a document table.

Several metadata dimensions are quantised to a few bits each, the Hilbert
index of the resulting grid cell orders all rows, and the order is cut into
runs of equal row counts.  A shard thus covers a compact box in every
dimension, so the minima and maxima of its files prune on each of them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert distance of integer grid cells, shape (rows, dims)."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(dims):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def category_cell(df: DataFrame, name: str, bits: int) -> Column:
    """A string dimension's cell: null is 0, and the values have cells by falling frequency.

    Seven eighths of the grid go to the most frequent values, one cell each at
    most, ties to the lesser value; few values stand evenly apart, so the curve
    tells them by its first bits.  The values beyond share the rest by hash, so
    many rare values crowd only there.
    """
    cells = 1 << bits
    own = (cells - 1) * 7 // 8
    ranked = df.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(own).collect()  # at most own rows
    col, top = F.col(name), [r[name] for r in ranked]
    rest = F.crc32(col) % (cells - 1 - own) + own + 1
    rank = F.array_position(F.array(*map(F.lit, top)), col) if top else F.lit(0)
    return F.when(col.isNull(), 0).when(rank > 0, 1 + F.floor((rank - 1) * own / max(1, len(top)))).otherwise(rest).cast("int")


def magnitude_cell(col: Column, bits: int) -> Column:
    """A count's cell: quarter powers of two, cut at the grid's edge."""
    return F.least(F.lit((1 << bits) - 1), F.floor(4 * F.log2(F.greatest(col.cast("double"), F.lit(0.0)) + 1))).cast("int")


def hilbert_order(df: DataFrame, cells: list[Column], key: str, bits: int) -> DataFrame:
    """Add ``hilbert`` and ``position``, the gapless rank of (hilbert, key, rest).

    Ranges of (hilbert, key) are sorted apart and numbered inside; the row
    counts of the ranges, one number a partition, give each its offset.
    """
    spark = df.sparkSession
    names = [f"__cell{i}" for i in range(len(cells))]
    withc = df.select("*", *[c.alias(n) for c, n in zip(cells, names)])

    @F.pandas_udf("long")
    def index(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in it:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cols], 1), bits))

    ties = [c for c in df.columns if c != key]
    ranged = (
        withc.withColumn("hilbert", index(*names)).drop(*names)
        .repartitionByRange("hilbert", key, *ties).sortWithinPartitions("hilbert", key, *ties)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    ranged = common.staged(ranged, "hilbert")
    per = ranged.groupBy(F.shiftright("__id", 33).alias("__part")).agg(F.count("*").alias("n")).collect()
    base, total = {}, 0
    for r in sorted(per, key=lambda r: r["__part"]):
        base[r["__part"]], total = total, total + r["n"]
    schema = "__part long, __base long"
    offsets = F.broadcast(spark.createDataFrame(sorted(base.items()), schema))
    return (
        ranged.withColumn("__part", F.shiftright("__id", 33)).join(offsets, "__part")
        .withColumn("position", F.col("__base") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("total", F.lit(total)).drop("__part", "__base", "__id")
    )


def cut_rows(df: DataFrame, shards: int) -> DataFrame:
    """Cut ``position`` into runs: the first total % shards get one row more."""
    small = F.floor(F.col("total") / shards)
    extra = F.col("total") % shards
    edge = extra * (small + 1)
    p = F.col("position")
    tail = F.when(small > 0, F.floor((p - edge) / F.greatest(small, F.lit(1)))).otherwise(0)
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(extra + tail)
    first = F.when(shard < extra, shard * (small + 1)).otherwise(edge + (shard - extra) * small)
    return df.withColumn("shard", shard.cast("int")).withColumn("slot", (p - first).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 7) -> DataFrame:
    """Row-balanced shards of documents ordered by lang, source and size.

    Null text has no bytes (size 16, crc32 0); null lang or source is a cell
    of its own; a null doc_id sorts first.  Repeated rows are rows of their
    own, ties of one cell and doc_id go by size and text hash; an empty table
    gives no rows; other columns are left out.  Only metadata moves, never
    the texts, however long.
    """
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        "lang", "source",
    )
    cells = [category_cell(meta, "lang", bits), category_cell(meta, "source", bits), magnitude_cell(F.col("size"), bits)]
    return cut_rows(hilbert_order(meta, cells, "doc_id", bits), shards)


def op3_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(common.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )
