"""Connected components of an edge table by local forests and alternating stars."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textnp import tidy

#: edges that a task gathers before it reduces them to a forest
FOREST_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least one that these edges connect it with."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while (top[a] != top[b]).any():
        x, y = top[a], top[b]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]
    hangs = top != np.arange(len(nodes))
    return nodes[hangs], nodes[top[hangs]]


def _forests(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: no more of them, and none with a greater sum."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.zeros(0, np.int64)
        kept = 0
        for batch in batches:
            u, v = (np.concatenate((x, batch.column(k).to_numpy())) for k, x in enumerate((u, v)))
            if len(u) - kept >= max(FOREST_EDGES, kept):
                u, v = stars(u, v)
                kept = len(u)
        u, v = stars(u, v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return common.staged(edges.mapInArrow(tidy(reduce), "u long, v long"), "edges")


def _with_least(arcs: DataFrame) -> DataFrame:
    """(u, v) arcs with m, the least of u and its neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return arcs.join(least, "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge names; component is its least node.

    Each task first reduces its edges to a forest of stars; edges that Spark
    puts into one partition are done with that.  Else large-star hangs each
    node's greater neighbours on its least one, small-star hangs the smaller
    ones and the node itself; the two alternate, with forests between, until
    nothing moves, in about log(nodes) rounds.  No step makes the sum of all
    edges' nodes greater, so what a round leaves as it was are stars.  Minima
    are aggregated before the shuffle and joined back, so no neighbour list is
    ever collected and a hub with a third of all edges is split by the join.
    """
    edges = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    edges = _forests(edges)
    before = None
    while len(edges.inputFiles()) > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.where("u != v").distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        last, edges = edges, _forests(small.where("u != v").distinct())
        common.discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
