"""Approximate nearest neighbours: inverted file with product quantisation.

Coarse centroids split the vectors into lists; the residual to the centroid is
product-quantised.  A query visits the lists whose centroids have the largest
inner product with it and ranks their members by an asymmetric distance table
(one row of 256 partial products for each part of the vector).  Its best over
all lists form one shortlist, and only they are ranked again by the exact
product, in double precision, on the original vectors.

Every vector is indexed.  The cells in which lists meet queries hold codes of
a few bytes, not vectors.  A list of more than ``block`` members is dealt over
several cells, so no task holds an unbounded group, and the queries that visit
a list are dealt in blocks in the same way.  A cell passes on only members
above the query's bar, which the fitted sample sets.

How many lists a query visits and how many members it ranks exactly is not
fixed: some of the queries themselves are answered by brute force first, one
pass over the table, and their true neighbours set both numbers.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 20_000
MAX_LISTS = 2048
BLOCK = 4096
#: sums of products of components below this fit a float
LARGE = 1e15
QUERY_BLOCK = 1024
#: members of all visited lists that a query ranks exactly, at least
RERANK = 150
#: queries that are answered by brute force to set the numbers of lists and of members
TRIALS = 128
#: components of a part of the product quantiser, and parts at most
PART_DIMS, MOST_PARTS = 4, 64


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers * centers).sum(1)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 8192):
        out[a : a + 8192] = np.argmax(x[a : a + 8192] @ centers.T - half, 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct rows; an empty centre keeps its place."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(distinct))
    centers = distinct[np.sort(rng.choice(len(distinct), k, replace=False))].copy()
    for _ in range(rounds):
        at = nearest(x, centers)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Index:
    """Centroids and one codebook of at most 256 entries for each part."""

    centers: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(x, self.centers)
        rest = x - self.centers[at]
        codes = np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], 1)
        return at, codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables, shape (queries, parts, 256)."""
        out = np.zeros((len(q), len(self.books), 256), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out[:, m, : len(book)] = q[:, a:b] @ book.T
        return out


def train(x: np.ndarray, lists: int, parts: int | None = None, seed: int = 3) -> Index:
    centers = kmeans(x, lists, 8, seed)
    rest = x - centers[nearest(x, centers)]
    parts = min(parts or int(np.clip(-(-x.shape[1] // PART_DIMS), 16, MOST_PARTS)), x.shape[1])
    edges = np.linspace(0, x.shape[1], parts + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Index(centers, [kmeans(rest[:, a:b], 256, 6, seed + 1 + i) for i, (a, b) in enumerate(cuts)], cuts)


def asymmetric(index: Index, q: np.ndarray, at: np.ndarray, codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Scores of coded members (list, codes) for each query, shape (queries, members)."""
    near = (q @ index.centers.T)[:, at]
    for m in range(codes.shape[1]):
        near += tables[:, m, :][:, codes[:, m]]
    return near


def tuned(index: Index, indexed: DataFrame, once: DataFrame, k: int, target: float, scale: float) -> tuple[int, int]:
    """(lists to visit, members to rank exactly) so that ``target`` of the true neighbours lie within each.

    TRIALS of the queries, chosen by hash, meet the whole table: a task passes
    on its k nearest a trial, then counts the members whose asymmetric scores
    reach those of the true neighbours.
    """
    trials = once.orderBy(F.xxhash64(F.lit(29), "query_id"), "query_id").limit(TRIALS).toArrow()
    own = trials.column("query_id").to_numpy()
    q, exact_q = matrix(trials.column("q"), scale), matrix(trials.column("q"), scale, np.float64)
    tables = index.tables(q)

    def read(b):
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(b), -1)
        at = b.column("list").to_numpy()
        for a in range(0, len(b), 2048):
            yield a, at[a : a + 2048], codes[a : a + 2048], b.column("vec_id").to_numpy()[a : a + 2048]

    def truth(batches):
        best = np.zeros((3, len(own), 0))  # exact score, list, asymmetric score
        for b in batches:
            x = matrix(b.column("vec"), scale, np.float64)
            for a, at, codes, ids in read(b):
                score = exact_q @ x[a : a + 2048].T
                score[own[:, None] == ids[None]] = -np.inf
                near = asymmetric(index, q, at, codes, tables).astype(float)
                best = np.concatenate((best, np.stack((score, np.broadcast_to(at, score.shape), near))), 2)
                if best.shape[2] > k:
                    top = np.argpartition(-best[0], k - 1, 1)[:, :k]
                    best = np.stack([np.take_along_axis(c, top, 1) for c in best])
        i, j = np.nonzero(best[0] > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), *(pa.array(c[i, j]) for c in best)], names=["trial", "score", "list", "near"])

    w = Window.partitionBy("trial").orderBy(F.desc("score"))
    found = indexed.mapInArrow(truth, "trial int, score double, list double, near double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    rows = found.select("trial", "list", "near").toArrow()  # k rows a trial
    if not len(rows):
        return 1, 1
    trial, at, near = rows.column("trial").to_numpy(), rows.column("list").to_numpy().astype(int), rows.column("near").to_numpy()
    place = np.argsort(np.argsort(-(q @ index.centers.T), 1, kind="stable"), 1)[trial, at]

    def ahead(batches):
        n = np.zeros(len(trial), np.int64)
        for b in batches:
            for _, lists, codes, _ in read(b):
                scores = np.sort(asymmetric(index, q, lists, codes, tables).astype(float), 1)
                for i in np.unique(trial):
                    mine = trial == i
                    n[mine] += len(lists) - np.searchsorted(scores[i], near[mine], "left")
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n)], names=["i", "n"])

    depth = [r["n"] for r in indexed.mapInArrow(ahead, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()]
    return int(np.quantile(place, target)) + 1, int(np.ceil(np.quantile(depth, target)))


def bars(index: Index, codes: tuple[np.ndarray, np.ndarray], q: np.ndarray, rank: int) -> np.ndarray:
    """Each query's ``rank``-th best asymmetric score among coded sample vectors."""
    at, code = codes
    tables, base = index.tables(q), q @ index.centers.T
    out = np.empty(len(q), np.float32)
    for i in range(len(q)):
        score = base[i][at]
        for m in range(code.shape[1]):
            score = score + tables[i, m][code[:, m]]
        out[i] = np.partition(score, -rank)[-rank]
    return out


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) without null, zero or non-finite vectors, of one length.

    The length is the table's most frequent one (the smaller at a tie).
    Vectors of floats stay floats; others become doubles.
    """
    v = F.col(vector)
    ok = v.isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    kind = df.schema[vector].dataType.simpleString()
    good = df.where(ok).select(F.col(key).cast("long").alias("vec_id"), (v if kind == "array<float>" else v.cast("array<double>")).alias("vec"))
    sizes = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return good.where(F.size("vec") == (sizes[0]["d"] if sizes else -1))


def matrix(column: pa.Array, scale: float = 1.0, kind: type = np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat if scale == 1.0 else flat * scale).reshape(len(column), -1).astype(kind)


def index_scale(vectors: DataFrame) -> float:
    """A power of two that brings doubles too large for the index's floats to at most 1; 1 for all others."""
    if vectors.schema["vec"].dataType.simpleString() == "array<float>":
        return 1.0
    most = vectors.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 0.0
    return 1.0 if most < LARGE else float(np.ldexp(1.0, -int(np.frexp(most)[1])))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = 0.97, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` rows nearest to each query by inner product: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have (vec_id, vec).  Rows of the query's own
    vec_id take no part.  A query visits at least 8 lists, as many as hold the
    ``target`` share of the trial queries' true neighbours, and lists of at
    least 10 k members together; the best of all their members are ranked
    exactly, at least ``rerank`` and as many as hold that share of the trials'
    true neighbours (``tuned``).  Codebooks and bars are fitted on about
    ``sample_rows`` vectors, chosen by hash.  A bar stands where the sample
    lets expect twice the members to rank above it, or at its tenth best if
    that is lower; queries that find fewer than the members to rank above it
    (clustered or repeated vectors) search again without one, so bars do not
    change what is found.

    Doubles too large for the index's floats are scaled in the index alone; the
    scores returned are those of the original vectors.

    Repeated vec_ids: each row is found for itself; as a query the least
    vector of the vec_id stands.  Ties go to the smaller vec_id.  An empty
    table on either side gives no rows; columns beside the two are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = vectors.count()
    if not n:
        return empty
    scale = index_scale(vectors)
    part = F.pmod(F.xxhash64(F.lit(17), "vec_id"), F.lit(1_000_000))
    picked = vectors.where(part < min(1_000_000, -(-1_000_000 * sample_rows // n))).select("vec_id", "vec").limit(2 * sample_rows).toArrow()
    if not len(picked):
        picked = vectors.limit(sample_rows).toArrow()
    picked = matrix(picked.take(pa.array(np.argsort(picked.column("vec_id").to_numpy(), kind="stable"))).column("vec"), scale)
    index = train(picked, int(np.clip(n**0.5, 1, MAX_LISTS)))
    n_lists = len(index.centers)

    def assign(batches):
        for b in batches:
            at, codes = index.encode(matrix(b.column(2), scale))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["row", "vec_id", "vec", "list", "codes"],
            )

    kind = vectors.schema["vec"].dataType.simpleString()
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")
    indexed = common.staged(numbered.mapInArrow(assign, f"row long, vec_id long, vec {kind}, list int, codes binary"), "ivf-index")
    once = common.staged(queries.groupBy("vec_id").agg(F.min("vec").alias("q")).withColumnRenamed("vec_id", "query_id"), "ivf-queries")
    lists, members = tuned(index, indexed, once, k, target, scale)
    n_probe, rerank = max(8, lists), max(rerank, members)
    rank = max(10, -(-2 * rerank * len(picked) // n))
    sample = index.encode(picked) if rank < len(picked) else None  # a small table needs no bar
    sizes = np.zeros(n_lists, np.int64)
    for r in indexed.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]

    def visit(batches):
        for b in batches:
            for a in range(0, len(b), 512):
                some = b.slice(a, 512)
                q = matrix(some.column(1), scale)
                bar = bars(index, sample, q, rank) if sample else np.full(len(q), -np.inf, np.float32)
                order = np.argsort(-(q @ index.centers.T), 1, kind="stable")
                reach = np.cumsum(sizes[order], 1)
                enough = (reach - sizes[order] < 10 * k + 1) | (np.arange(n_lists) < n_probe)
                row, col = np.nonzero(enough & (sizes[order] > 0))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), pa.array(q.tolist(), pa.list_(pa.float32())).take(at), pa.array(bar[row]), pa.array(order[row, col].astype(np.int32))], names=["query_id", "q", "bar", "list"])

    visits = common.staged(once.repartition(common.parts(spark), "query_id").mapInArrow(visit, "query_id long, q array<float>, bar float, list int"), "ivf-visits")
    wanted = np.zeros(n_lists, np.int64)
    for r in visits.groupBy("list").count().collect():  # one row a list
        wanted[r["list"]] = r["count"]
    per_list = spark.createDataFrame(
        [(i, int(-(-s // BLOCK)), int(-(-w // QUERY_BLOCK))) for i, (s, w) in enumerate(zip(sizes.tolist(), wanted.tolist())) if s and w],
        "list int, blocks int, query_blocks int",
    )
    per_list = F.broadcast(per_list)  # at most MAX_LISTS rows
    rows = indexed.join(per_list, "list").select(
        "list", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "row", "vec_id", "codes",
    )
    cell = ["list", "block", "query_block"]

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "row": [], "vec_id": [], "near": []}
        if len(left) and len(right):
            left = left.take(pa.array(np.lexsort((left.column("row").to_numpy(), left.column("vec_id").to_numpy()))))
            rows, ids = left.column("row").to_numpy(), left.column("vec_id").to_numpy()
            codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            base = index.centers[left.column("list")[0].as_py()]
            qids, qs, bar = right.column("query_id").to_numpy(), matrix(right.column("q")), right.column("bar").to_numpy()
            for a in range(0, len(qids), 64):
                q = qs[a : a + 64]
                tables = index.tables(q)
                near = np.repeat((q @ base)[:, None], len(ids), 1)
                for m in range(codes.shape[1]):
                    near += tables[:, m, :][:, codes[:, m]]
                for i, row in enumerate(near):
                    best = np.flatnonzero((row >= bar[a + i]) & (ids != qids[a + i]))
                    if len(best) > rerank:  # of equal scores the smaller vec_ids stay
                        least = np.partition(row[best], -rerank)[-rerank]
                        above, level = best[row[best] > least], best[row[best] == least]
                        best = np.concatenate((above, level[: rerank - len(above)]))
                    found["query_id"].append(np.full(len(best), qids[a + i]))
                    found["row"].append(rows[best])
                    found["vec_id"].append(ids[best])
                    found["near"].append(row[best])
        kinds = {"query_id": np.int64, "row": np.int64, "vec_id": np.int64, "near": np.float32}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in found.items()})

    def shortlist(asking: DataFrame) -> DataFrame:
        """(query_id, row): the best of each query over all its lists by asymmetric score."""
        asked = asking.join(per_list, "list").select(
            "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"), "query_id", "q", "bar",
        )
        hits = rows.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(scan, "query_id long, row long, vec_id long, near float")
        w = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "row")
        return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank).select("query_id", "row")

    short = common.staged(shortlist(visits), "ivf-shortlist")
    if sample:
        poor = once.join(short.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left").where(F.coalesce("c", F.lit(0)) < rerank).select("query_id")
        poor = common.staged(poor, "ivf-poor")
        if not poor.isEmpty():
            again = shortlist(visits.join(poor, "query_id", "left_semi").withColumn("bar", F.lit(float("-inf")).cast("float")))
            short = common.staged(short.join(poor, "query_id", "left_anti").unionByName(again), "ivf-shortlist")
    product = F.aggregate(F.zip_with("q", "vec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    exact = short.join(once, "query_id").join(indexed.select("row", "vec_id", "vec"), "row").select("query_id", "vec_id", product.alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose vec_id is divisible by 20."""
    vectors = valid_vectors(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
