"""Correlation of many columns by blocks, and greedy pruning by rounds.

No task and no driver holds a matrix of all columns: a task adds up products
of a few pairs of column blocks, a block pair's sums meet in one task, and
only pairs above the limit go on.

Greedy pruning takes pairs by falling correlation.  What it does with a pair
depends only on stronger pairs of the same two columns, so all pairs that are
the strongest left for both of their columns are settled at once, round by
round, with the result of one pair after another.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged

BLOCK = 512
#: sums of block pairs that one task holds at a time; further pairs take another pass
SUMS_BYTES = 64 << 20


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)


def with_target(vectors: DataFrame, features: str, target: str) -> DataFrame:
    """One array a row, the target at its end."""
    return vectors.select(F.concat(F.col(features).cast("array<double>"), F.array(F.col(target).cast("double"))).alias("x"))


def moments(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred lengths of all columns."""
    first = rows.limit(1).toArrow()
    shift = matrix(first.to_batches()[0])[0] if len(first) else np.zeros(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(d), np.zeros(d)
        for b in batches:
            x = matrix(b) - shift
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([v.tobytes()], pa.binary()) for v in (s, q))], names=["n", "s", "q"])

    n, s, q = 0, np.zeros(d), np.zeros(d)
    for r in rows.mapInArrow(add, "n long, s binary, q binary").coalesce(16).collect():  # one row a task
        n, s, q = n + r["n"], s + np.frombuffer(r["s"]), q + np.frombuffer(r["q"])
    mean = s / max(1, n)
    return mean + shift, np.sqrt(np.maximum(q - n * mean * mean, 0))


PAIRS = "first string, second string, strength double, lose string, win string"


def strong_pairs(vectors: DataFrame, features: str, target: str, names: list[str], limit: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(first, second, strength, lose, win): the pairs of columns whose absolute correlation passes ``limit``.

    ``first`` stands before ``second`` among the columns.  The column farther
    from the target loses; at a tie the one whose name is greater.
    """
    d = len(names)
    rows = staged(with_target(vectors, features, target), "correlation-input")
    mean, length = moments(rows, d + 1)
    length = np.where(length > 0, length, np.nan)
    edges = [(a, min(a + block, d)) for a in range(0, d, block)]
    cells = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    size = max(1, SUMS_BYTES // (8 * min(block, d) ** 2))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d)
        for b in batches:
            z = (matrix(b) - mean) / length
            total += z[:, :d].T @ z[:, d]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total)], names=["i", "t"])

    close = np.zeros(d)
    for r in rows.mapInArrow(near, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect():  # one row a column
        close[r["i"]] = abs(r["t"])

    def sums(some: list[tuple[int, int]]):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {c: np.zeros((edges[c[0]][1] - edges[c[0]][0], edges[c[1]][1] - edges[c[1]][0])) for c in some}
            for b in batches:
                z = (matrix(b)[:, :d] - mean[:d]) / length[:d]
                for (i, j), t in total.items():
                    t += z[:, slice(*edges[i])].T @ z[:, slice(*edges[j])]
            for (i, j), t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["i", "j", "sums"])

        return rows.mapInArrow(add, "i int, j int, sums binary")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, blob in zip(*(c.to_pylist() for c in b.columns)):
                held[i, j] = held.get((i, j), 0) + np.frombuffer(blob)
        for (i, j), t in held.items():
            r = np.abs(t.reshape(edges[i][1] - edges[i][0], -1))
            p, q = np.nonzero(r > limit)
            s, p, q = r[p, q], p + edges[i][0], q + edges[j][0]
            s, p, q = (v[p < q] for v in (s, p, q))
            out = []
            for strength, a, b in zip(s.tolist(), p.tolist(), q.tolist()):
                lose, win = (a, b) if close[a] < close[b] else (b, a) if close[b] < close[a] else sorted((a, b), key=names.__getitem__)[::-1]
                out.append((names[a], names[b], strength, names[lose], names[win]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string()))], names=[c.split()[0] for c in PAIRS.split(", ")])

    parts = None
    for a in range(0, len(cells), size):
        part = sums(cells[a : a + size])
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return vectors.sparkSession.createDataFrame([], PAIRS)
    return parts.repartition(min(len(cells), 200), "i", "j").mapInArrow(judge, PAIRS)


def pruned(pairs: DataFrame) -> DataFrame:
    """(dropped, because_of) of greedy pruning over the pairs, by rounds."""
    spark = pairs.sparkSession
    gone = spark.createDataFrame([], "dropped string, because_of string")
    order = F.struct((-F.col("strength")).alias("s"), "first", "second")
    left = staged(pairs.withColumn("place", order), "prune-pairs")
    while not left.isEmpty():
        ends = left.select(F.col("first").alias("column"), "place").union(left.select(F.col("second").alias("column"), "place"))
        best = ends.groupBy("column").agg(F.min("place").alias("best"))
        on = lambda c: best.select(F.col("column").alias(c), F.col("best").alias(f"best_{c}"))
        settled = left.join(on("first"), "first").join(on("second"), "second").where("place = best_first and place = best_second")
        now = staged(settled.select(F.col("lose").alias("dropped"), F.col("win").alias("because_of")), "prune-round")
        gone = gone.unionByName(now)
        # pairs of a column that went are passed over, the settled ones among them
        for c in ("first", "second"):
            left = left.join(now.select(F.col("dropped").alias(c)), c, "left_anti")
        left = staged(left.select(*pairs.columns, "place"), "prune-pairs")
    return gone


def prune_correlated(vectors: DataFrame, features: str, target: str, names: list[str], limit: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(dropped, because_of): columns that go because a stronger one stays; constant columns correlate with nothing."""
    return pruned(strong_pairs(vectors, features, target, names, limit, block))
