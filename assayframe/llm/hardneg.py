"""Hard negatives through an inverted multi-index, exact.

A vector is cut in two halves, each with a codebook of its own; a pair of
codewords is a cell.  For an anchor, a half's score in a cell is at most the
product with the codeword plus the anchor's length times the codeword's
radius.  A heap over the two sorted lists of half bounds (multi-sequence)
gives cells by falling sums of bounds.  A search ends when the next cell's
bound lies below what it has: below the last positive it needs, then below
the last negative of every window.  So the result is that of a full scan.

Anchors meet cells in rounds.  In each, an anchor still open takes cells of a
growing number of rows from its heap; cells lie in blocks of a bounded size,
and a block meets the anchors that ask for it in bounded blocks too.  Only the
best few of each meeting move on.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .ivfpq import kmeans, nearest

SAMPLE_ROWS = 20_000
BLOCK = 4096
ANCHOR_BLOCK = 1024
#: codewords a half at most: one count a cell comes to the driver
MOST_WORDS = 256
#: rows in the cells of an anchor's first round, and growth from round to round
FIRST_ROWS, GROWTH = 8192, 8
SCALE = 256
#: float sums are exact below this
EXACT = float(1 << 53)


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(row, vec_id, label, x): rows that take part, components as whole numbers.

    Out go rows with a null id, label or vector or a null or non-finite
    component, and vectors of another length than most have (the smaller at a
    tie).  Components beyond 2**31.5 / sqrt(length) are cut to that size: no
    score of them would fit 64 bits.
    """
    v = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    good = df.where(ok).select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), v.alias("x"))
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    most = int((float(1 << 62) / max(1, d)) ** 0.5)
    whole = F.transform("x", lambda e: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(e * SCALE))).cast("long"))
    good = good.where(F.size("x") == d)
    return common.staged(good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("x")), "mine-rows")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    largest = lambda a: float(np.abs(a).max(initial=0))
    if x.shape[1] * largest(x) * largest(q) < EXACT:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    return x @ q.T


@dataclass
class MultiIndex:
    """Two codebooks, the radius of each codeword, and the rows of each cell."""

    cut: int
    books: list[np.ndarray]
    radii: list[np.ndarray] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut].astype(np.float64), x[:, self.cut :].astype(np.float64)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells and distances to the codewords of both halves."""
        at = [nearest(h, b) if b.shape[1] else np.zeros(len(h), np.int64) for h, b in zip(self.halves(x), self.books)]
        far = [np.sqrt(((h - b[i]) ** 2).sum(1)) for h, b, i in zip(self.halves(x), self.books, at)]
        return at[0] * len(self.books[1]) + at[1], far

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Least and greatest half scores of one anchor by codeword."""
        low, high = [], []
        for h, book, radius in zip(self.halves(q[None, :]), self.books, self.radii):
            middle, length = book @ h[0], np.sqrt((h[0] ** 2).sum())
            slack = length * radius + 1e-9 * (np.abs(book) @ np.abs(h[0]) + length * radius) + 1e-6
            low.append(middle - slack)
            high.append(middle + slack)
        return low, high

    def falling(self, q: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(greatest score, least score, cell) of cells that hold rows, by falling greatest score."""
        (low1, low2), (high1, high2) = self.bounds(q)
        first, second = np.argsort(-high1, kind="stable"), np.argsort(-high2, kind="stable")
        h1, h2, l1, l2 = (v.tolist() for v in (high1[first], high2[second], low1[first], low2[second]))
        first, second, width = first.tolist(), second.tolist(), len(second)
        counts = self.counts
        heap = [(-(h1[0] + h2[0]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if i + 1 < len(h1) and j == 0:
                heapq.heappush(heap, (-(h1[i + 1] + h2[0]), i + 1, 0))
            if j + 1 < width:
                heapq.heappush(heap, (-(h1[i] + h2[j + 1]), i, j + 1))
            cell = first[i] * width + second[j]
            if counts[cell]:
                yield -bound, l1[i] + l2[j], cell


def fitted(rows: DataFrame, n: int, seed: int = 11) -> MultiIndex:
    """Codebooks from about SAMPLE_ROWS rows, chosen by hash; about four times the square root of ``n`` cells."""
    share = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(1_000_000))
    picked = rows.where(share < min(1_000_000, -(-1_000_000 * SAMPLE_ROWS // n))).select("row", "x").limit(2 * SAMPLE_ROWS).toArrow()
    if not len(picked):
        picked = rows.select("row", "x").limit(SAMPLE_ROWS).toArrow()
    x = matrix(picked.take(pa.array(np.argsort(picked.column("row").to_numpy(), kind="stable"))).column("x"))
    words = int(np.clip(2 * n**0.25, 1, MOST_WORDS))
    index = MultiIndex(x.shape[1] // 2, [])
    index.books = [kmeans(h, words, 8, seed + i) if h.shape[1] else np.zeros((1, 0)) for i, h in enumerate(index.halves(x))]
    return index


def indexed(rows: DataFrame, index: MultiIndex) -> DataFrame:
    """Every row with its cell; fills in the counts and radii of ``index``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, far = index.assign(matrix(b.column(3)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), *map(pa.array, far)], names=[*b.schema.names, "cell", "far1", "far2"])

    out = common.staged(rows.mapInArrow(assign, "row long, vec_id long, label int, x array<long>, cell int, far1 double, far2 double"), "mine-index")
    shape = len(index.books[0]), len(index.books[1])
    counts, radii = np.zeros(shape, np.int64), [np.zeros(shape), np.zeros(shape)]
    for r in out.groupBy("cell").agg(F.count("*"), F.max("far1"), F.max("far2")).collect():  # one row a cell
        at = divmod(r[0], shape[1])
        counts[at], radii[0][at], radii[1][at] = r[1], r[2], r[3]
    index.counts, index.radii = counts.ravel(), [radii[0].max(1), radii[1].max(0)]
    return out


def blocks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share one, large ones are split."""
    first, pieces = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BLOCK))
    block, held = 0, 0
    for c, n in enumerate(counts.tolist()):
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        first[c] = block
        held += n
        if pieces[c] > 1:
            block, held = block + int(pieces[c]), 0
    return first, pieces


def best_first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest scores, ties in their order."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


class Search:
    """Rounds over an index; ``windows`` of an anchor are (least, greatest) scores, of rows with its label or without."""

    def __init__(self, index: MultiIndex, rows: DataFrame, k: int, same: bool):
        self.index, self.rows, self.k, self.same = index, rows, k, same
        self.first, self.pieces = blocks_of(index.counts)
        spark = rows.sparkSession
        cells = [(c, int(self.first[c]), int(self.pieces[c])) for c in np.flatnonzero(index.counts).tolist()]
        table = F.broadcast(spark.createDataFrame(cells, "cell int, first int, pieces int"))  # MOST_WORDS**2 rows at most
        block = F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")
        self.blocked = rows.join(table, "cell").select(block.alias("block"), "row", "vec_id", "label", "x", "cell")

    def visits(self, open_: DataFrame, budget: int) -> DataFrame:
        """(anchor, label, q, lows, highs, block, cells) asked for, and (anchor, taken, next) of each anchor with a null block."""
        index, first, pieces = self.index, self.first, self.pieces
        schema = "anchor long, label int, q array<long>, lows array<long>, highs array<long>, block int, cells array<int>, taken int, next double"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, len(whole), 16):
                    yield some(whole.slice(a, 16))

        def some(batch: pa.RecordBatch) -> pa.RecordBatch:
            q, stop = matrix(batch.column(2)), batch.column(6).to_numpy(zero_copy_only=False)
            taken, highs = batch.column(5).to_pylist(), batch.column(4).to_pylist()
            at, block, cells, now, bound = [], [], [], [], []
            for i in range(len(batch)):
                walk, rows, n, want, following = index.falling(q[i]), 0, 0, {}, -np.inf
                ceiling = max(highs[i]) if highs[i] else -np.inf
                for n, (most, least, cell) in enumerate(walk):
                    if n < taken[i]:
                        continue
                    if most < stop[i] or rows >= budget:
                        following = most
                        break
                    if least <= ceiling:  # else the whole cell lies above every window
                        rows += int(index.counts[cell])
                        for piece in range(first[cell], first[cell] + pieces[cell]):
                            want.setdefault(piece, []).append(cell)
                else:
                    n += 1
                at += [i] * (len(want) + 1)
                block += [*want, None]
                cells += [*want.values(), None]
                now += [n] * (len(want) + 1)
                bound += [following] * (len(want) + 1)
            kept = [batch.column(c).take(pa.array(at)) for c in range(5)]
            return pa.RecordBatch.from_arrays([*kept, pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(now, pa.int32()), pa.array(bound, pa.float64())], names=["anchor", "label", "q", "lows", "highs", "block", "cells", "taken", "next"])

        asking = open_.select("anchor", "label", "q", "lows", "highs", "taken", "stop")
        return asking.repartition(common.parts(open_.sparkSession), "anchor").mapInArrow(ask, schema)

    def met(self, asked: DataFrame) -> DataFrame:
        """(anchor, window, row, vec_id, score): the best of each meeting of a block with anchors."""
        k, same = self.k, self.same
        wanted = asked.groupBy("block").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("lots"))
        left = self.blocked.join(wanted, "block").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        right = asked.join(wanted, "block").withColumn("lot", F.pmod(F.xxhash64("anchor"), F.col("lots")).cast("int"))
        schema = "anchor long, window int, row long, vec_id long, score long"

        def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
            out = {c: [] for c in ("anchor", "window", "row", "vec_id", "score")}
            if len(rows) and len(anchors):
                row, vec, label, cell = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label", "cell"))
                order = np.lexsort((row, vec))
                row, vec, label, cell, x = row[order], vec[order], label[order], cell[order], matrix(rows.column("x"))[order]
                own, q, kinds = anchors.column("anchor").to_numpy(), matrix(anchors.column("q")), anchors.column("label").to_numpy()
                asks = [anchors.column(c).to_pylist() for c in ("cells", "lows", "highs")]
                for a in range(0, len(own), 64):
                    score = products(x, q[a : a + 64])
                    for i in range(a, min(a + 64, len(own))):
                        cells, lows, highs = (v[i] for v in asks)
                        fits = np.isin(cell, cells) & ((label == kinds[i]) == same) & (row != own[i])
                        for w, (low, high) in enumerate(zip(lows, highs)):
                            s = score[:, i - a]
                            at = np.flatnonzero(fits & (s >= low) & (s <= high))
                            at = at[best_first(s[at], k)]
                            for c, v in zip(out, (np.full(len(at), own[i]), np.full(len(at), w), row[at], vec[at], s[at])):
                                out[c].append(v)
            kinds_ = {"anchor": pa.int64(), "window": pa.int32(), "row": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
            return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds_[c]) for c, v in out.items()})

        drop = ["lots"]
        return left.drop(*drop).groupBy("block", "lot").cogroup(right.drop(*drop).groupBy("block", "lot")).applyInArrow(meet, schema)

    def run(self, anchors: DataFrame) -> DataFrame:
        """(anchor, window, r, row, vec_id, score): the first ``k`` of every window of ``anchors`` (anchor, label, q, lows, highs)."""
        w = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
        floor = F.array_min("lows").cast("double")
        open_ = anchors.where(F.size("lows") > 0).withColumns({"taken": F.lit(0), "stop": floor})
        best, budget = None, FIRST_ROWS
        while True:
            asked = common.staged(self.visits(open_, budget), "mine-visits")
            fresh = self.met(asked.where("block is not null").select("anchor", "label", "q", "lows", "highs", "block", "cells"))
            every = fresh if best is None else fresh.unionByName(best.drop("r"))
            last, best = best, common.staged(every.withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.k), "mine-best")
            # a window is sure of what lies at or above its k-th score, or its lower end where it has fewer
            full = best.where(F.col("r") == self.k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("full"))
            state = asked.where("block is null").drop("block", "cells").join(full, "anchor", "left")
            sure = F.transform("lows", lambda low, i: F.coalesce(F.try_element_at("full", i.cast("int")), low))
            state = state.withColumn("stop", F.array_min(sure).cast("double")).where("next >= stop")
            state = common.staged(state.drop("full", "next"), "mine-open")
            common.discard(last, asked)
            if state.isEmpty():
                return best
            open_, budget = state, budget * GROWTH


LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def mine(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``.  An anchor's positives are the
    first ``positives`` other rows of its label by integer inner product, ties
    by smaller id.  For each, the first ``negatives`` rows of other labels
    whose score is at least ``low`` and at most ``high`` hundredths of the
    positive's are returned.  A negative positive score leaves no such row.

    Repeated ids are rows of their own: an anchor's other row may have its id,
    and each of the rows is an anchor.  Zero vectors take part.  Fewer rows
    than asked for are all returned.  An empty table, one without anchors or
    one with a single label gives no rows.  Columns beside the three are ignored.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector, label)
    n = rows.count()
    anchors = rows.where(is_anchor)
    if not n or anchors.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    index = fitted(rows, n)
    cells = indexed(rows, index)
    everything = [F.array(F.lit(v).cast("long")) for v in (LEAST, GREATEST)]
    asking = anchors.select(F.col("row").alias("anchor"), "label", F.col("x").alias("q"), everything[0].alias("lows"), everything[1].alias("highs"))
    good = Search(index, cells, positives, same=True).run(asking)
    by_anchor = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("good"))  # of ``positives`` at most
    bounded = common.staged(asking.drop("lows", "highs").join(by_anchor, "anchor"), "mine-positives")
    hundredths = lambda p, share: (p["score"].cast("decimal(20,0)") * F.lit(share).cast("decimal(4,0)")) / F.lit(100).cast("decimal(3,0)")
    windows = {
        "lows": F.transform("good", lambda p: F.ceil(hundredths(p, low)).cast("long")),
        "highs": F.transform("good", lambda p: F.floor(hundredths(p, high)).cast("long")),
    }
    bad = Search(index, cells, negatives, same=False).run(bounded.withColumns(windows).drop("good"))
    named = bounded.select("anchor", F.posexplode("good").alias("window", "p")).join(rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    out = bad.withColumnRenamed("vec_id", "negative_id").join(named, ["anchor", "window"])
    return out.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("r").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_multi_index_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 100; labels of ids divisible by 7 move on by one."""
    vectors = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)
