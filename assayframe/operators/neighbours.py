"""K-nearest-neighbour regression, exact, over cells of the training points.

Equal feature vectors are one point, of which only the ``k`` smallest keys can
count.  Points are dealt into cells by cuts that a sample sets; the cells'
boxes bound the distance from a test point to whatever lies in them, so a test
point meets its own cell first and then only cells whose box is not farther
than its k-th nearest so far.  The cuts decide the work, never the result.
With many features boxes overlap each other's reach and most cells are visited:
exact search then compares all pairs of points, by blocks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: points of the sample that sets the cuts
SAMPLE = 100_000


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cuts_of(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """(feature, cut, left, right) of a tree of about ``cells`` leaves over sampled points; a negative child is leaf ~child."""
    tree: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal leaves
        spread = np.ptp(x[rows], 0) if want > 1 and len(rows) > 1 else np.zeros(1)
        if not spread.max() > 0:
            leaves += 1
            return ~(leaves - 1)
        f = int(np.argmax(spread))
        v = np.sort(x[rows, f])
        cut = v[len(v) // 2]
        cut = cut if cut > v[0] else v[np.searchsorted(v, cut, "right")]  # both sides get some
        me = len(tree)
        tree.append((f, float(cut), 0, 0))
        low = x[rows, f] < cut
        tree[me] = (f, float(cut), grow(rows[low], want // 2), grow(rows[~low], want - want // 2))
        return me

    grow(np.arange(len(x)), cells)
    return tree


def cell_of(tree: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    stack = [(0 if tree else ~0, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        if node < 0:
            out[rows] = ~node
        elif len(rows):
            f, cut, left, right = tree[node]
            low = x[rows, f] < cut
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def gaps(z: np.ndarray, low: np.ndarray, high: np.ndarray, p: int) -> np.ndarray:
    """The least distance of each point to each box, added up as distances are."""
    d = np.zeros((len(z), len(low)))
    for f in range(z.shape[1]):
        d += np.maximum(0, np.maximum(low[:, f] - z[:, f, None], z[:, f, None] - high[:, f])) ** p
    return d ** (1 / p)


def knn_predict(train: DataFrame, test: DataFrame, key: str, features: str, target: str, k: int = 5, weights: str = "uniform", p: int = 2, block: int = 1024) -> DataFrame:
    """(key, predicted) of the test rows; k is cut to the training size, ties go to the smaller key.

    A task holds about ``block`` training points and as many test points at a
    time, the shuffle k rows a visit.  Rows whose features hold a null or a
    non-finite number take no part on either side.
    """
    kind = dict(train.dtypes)[key]
    x = F.col(features).cast("array<double>")
    ok = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    same = F.transform(x, lambda e: e + F.lit(0.0))  # one zero
    rows = train.where(ok).select(F.col(key).alias("tk"), same.alias("x"), F.col(target).cast("double").alias("y"))
    first = Window.partitionBy("x").orderBy("tk")
    rows = staged(rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k), "knn-rows")
    asked = staged(test.where(ok).select(F.col(key).alias("q"), same.alias("x")), "knn-asked")
    points = rows.where("r = 1")
    n = points.count()
    k = min(k, rows.count())
    if not n:
        return asked.limit(0).select(F.col("q").alias(key), F.lit(None).cast("double").alias("predicted"))
    step = max(1, n // SAMPLE)
    some = points.where(F.pmod(F.xxhash64("x", F.lit(7)), F.lit(step)) == 0).select("x").limit(2 * SAMPLE).toArrow()
    tree = cuts_of(matrix(some.column("x")), max(1, -(-n // block))) if len(some) else []

    def deal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of(tree, matrix(b.column(b.schema.get_field_index("x")))))], names=[*b.schema.names, "cell"])

    left = staged(rows.drop("r").mapInArrow(deal, f"tk {kind}, x array<double>, y double, cell long"), "knn-cells")
    dims = len(some.column("x")[0]) if len(some) else points.select(F.size("x")).first()[0]
    ends = [f(F.col("x")[i]).alias(f"{a}{i}") for a, f in (("lo", F.min), ("hi", F.max)) for i in range(dims)]
    boxes = left.groupBy("cell").agg(F.count("*").alias("n"), *ends).orderBy("cell").toArrow()  # one row a cell
    cells = boxes.column("cell").to_numpy()
    low, high = (np.stack([boxes.column(f"{a}{i}").to_numpy() for i in range(dims)], 1) for a in ("lo", "hi"))
    lot = train.sparkSession.sparkContext.broadcast((cells, low, high))
    pieces = F.broadcast(train.sparkSession.createDataFrame([(int(c), max(1, -(-m // (4 * block)))) for c, m in zip(cells.tolist(), boxes.column("n").to_pylist())], "cell long, pieces int"))
    right = asked.select("x").distinct().select(F.monotonically_increasing_id().alias("id"), "x")  # equal test points ask once
    right = staged(right.mapInArrow(deal, "id long, x array<double>, cell long"), "knn-points")

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("tk", a.schema.field("tk").type), ("d", pa.float64()), ("y", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        a = a.sort_by("tk")
        t, z = matrix(a.column("x")), matrix(b.column("x"))
        take, distance, row = [], [], []
        much, some = min(k, len(t)), max(1, (1 << 21) // len(t))
        for at in range(0, len(z), some):  # a block of test points meets the whole cell at once
            d = np.zeros((len(z[at : at + some]), len(t)))
            for f in range(t.shape[1]):
                d += np.abs(t[:, f] - z[at : at + some, f, None]) ** p
            d = d ** (1 / p)
            bar = np.partition(d, much - 1, axis=1)[:, much - 1]
            i, j = np.nonzero(d <= bar[:, None])  # in key order, so ties go to the smaller key
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i, "left")
            i, j = i[place < much], j[place < much]
            take.append(j)
            distance.append(d[i, j])
            row.append(at + i)
        take, row = np.concatenate(take), np.concatenate(row)
        return pa.table([b.column("id").take(pa.array(row)), a.column("tk").take(pa.array(take)), pa.array(np.concatenate(distance)), a.column("y").take(pa.array(take))], schema=schema)

    near_schema = f"id long, tk {kind}, d double, y double"
    dealt = left.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64("tk"), F.col("pieces")).cast("int")).drop("pieces")

    def meet(visits: DataFrame, name: str) -> DataFrame:
        """The k nearest of each test point within the cells it visits; a cell's visitors are dealt into groups."""
        many = visits.groupBy("cell").agg(F.ceil(F.count("*") / (8 * block)).cast("int").alias("groups")).join(pieces, "cell")
        many = F.broadcast(staged(many, "knn-groups"))  # one row a cell
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        a = dealt.join(many.drop("pieces"), "cell").select("cell", "piece", every("groups").alias("g"), "tk", "x", "y")
        b = visits.join(many, "cell").select("cell", every("pieces").alias("piece"), F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("g"), "id", "x")
        found = a.groupBy("cell", "piece", "g").cogroup(b.groupBy("cell", "piece", "g")).applyInArrow(near, near_schema)
        return staged(found, name)

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("id").orderBy("d", "tk")
        return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)

    own = staged(best(meet(right, "knn-own")), "knn-near")
    reach = own.groupBy("id").agg(F.max(F.when(F.col("r") == k, F.col("d"))).alias("reach"))
    asks = right.join(reach, "id", "left").select("id", "x", "cell", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))

    def further(batches):
        cells, low, high = lot.value
        for b in batches:
            for at in range(0, len(b), some_rows := max(1, (1 << 21) // len(cells))):
                part = b.slice(at, some_rows)
                d = gaps(matrix(part.column(1)), low, high, p)
                reach = part.column(3).to_numpy()
                i, j = np.nonzero((d <= reach[:, None] * (1 + 1e-12)) & (cells != part.column(2).to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(cells[j])], names=["id", "x", "cell"])

    beyond = staged(asks.mapInArrow(further, "id long, x array<double>, cell long"), "knn-visits")
    top = best(own.drop("r").unionByName(meet(beyond, "knn-beyond")))
    if weights == "distance":
        zero = F.max((F.col("d") == 0).cast("int"))
        exact = F.avg(F.when(F.col("d") == 0, F.col("y")))
        inverse = F.try_divide(F.sum(F.try_divide(F.col("y"), F.col("d"))), F.sum(F.try_divide(F.lit(1.0), F.col("d"))))
        value = F.when(zero == 1, exact).otherwise(inverse)
    else:
        value = F.avg("y")
    said = right.select("id", "x").join(top.groupBy("id").agg(value.alias("predicted")), "id").drop("id")
    return asked.join(said.hint("merge"), "x").select(F.col("q").alias(key), "predicted")
