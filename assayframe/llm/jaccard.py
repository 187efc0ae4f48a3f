"""Exact similarity join of word-shingle sets by prefix filters in several orders.

Two sets whose Jaccard similarity reaches t share a token among the first
n - ceil(t n) + 1 of each, whatever global order the tokens have.  Candidates
come from an index of those prefixes under one order (rare tokens first) with
length and position filters.  Only the prefixes under two further orders then
move, and pairs that share no token in either of them go; the full sets move
for what is left, and are intersected.

Sets that are equal are one node.  Lists of up to SHORT_LIST nodes give all
their pairs where they are gathered, so their postings move once; the pairs
are counted over all lists.  Each node first meets its best supported
partners, the verified links are contracted, and only pairs of different
components follow.  In longer lists one node of each component meets those of
the list's largest one before all others do.

No list is held whole: postings of a token that the sketch calls hot are dealt
over several parts, the components of a long list are counted before the
shuffle, and a list of more than LIST_BLOCK nodes meets itself block by block.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .places import Placed, placed, row_hash
from .textnp import U, chunks, mix, ragged, shingle_sets, tidy

SKETCH_BITS = 20
SLOTS = 128
SHINGLE = 5
#: similarity at least NUM / DEN
NUM, DEN = 80, 100
POSTINGS_A_PART = 1_000_000
#: partners that a node tries first, and rounds in which components meet the largest of each list
FIRST_PARTNERS = 2
HUB_ROUNDS = 1
#: nodes of a list that gives all its pairs at once
SHORT_LIST = 8
#: postings of one token in a part, and nodes of one list that meet in a cell
HOT_POSTINGS = 100_000
LIST_BLOCK = 512
#: rows of cells that one task takes
CELL_ROWS = 2_000_000
ORDERS = (U(0x632BE59BD9B4E019), U(0x8CB92BA72F3D8DD7), U(0xAC565AD4ED9B4F3B))


def fingerprint(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; order of tokens does not matter."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(flat ^ U(0x5851F42D4C957F2D)))))
    n = (bounds[1:] - bounds[:-1]).astype(U)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * U(0x9E3779B97F4A7C15)).view(np.int64)


def order_keys(flat: np.ndarray, classes: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of tokens under one order: frequency class, then a seeded hash."""
    bucket = (flat >> U(64 - SKETCH_BITS)).astype(np.int64)
    return (classes[bucket].astype(U) << U(56)) | (mix(flat ^ ORDERS[order]) >> U(8))


def bins(n: int) -> int:
    """Histogram bins of a set: a power of two with two to four tokens a bin."""
    return max(16, 1 << max(0, (n // 2).bit_length() - 1))


def histograms(flat: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Tokens of each set by hash bin; the sum of minima bounds an intersection."""
    low = (flat & U(0xFFFFFFFF)).astype(np.int64)
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        k = bins(e - s)
        out.append(np.bincount(low[s:e] & (k - 1), minlength=k).astype(np.uint8).tobytes() if e > s else b"")
    return out


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = x.reshape(-1, len(y)).sum(0)
    return int(np.minimum(x, y).sum())


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n - -(-n * NUM // DEN) + 1, 0)


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """Order classes of sketch buckets, from rare to frequent.

    Counts within eight deviations of the mean load get eighths of a deviation
    each, so a token of moderate frequency already stands after most others;
    beyond, classes are eighths of doublings.
    """
    mean = max(1.0, counts.mean())
    step = max(1.0, mean**0.5 / 8)
    low, bar = max(0.0, mean - 4 * mean**0.5), mean + 8 * mean**0.5
    inner = np.clip((counts - low) / step, 0, 100)
    outer = 101 + 8 * np.log2(np.maximum(counts, bar) / bar)
    return np.clip(np.floor(np.where(counts <= bar, inner, outer)), 0, 255).astype(np.uint8)


def scan_sets(docs: Placed) -> DataFrame:
    """Per document (row, doc_id, tie, fp, n, histogram); per task and slot a piece of the token-count sketch."""
    names = ["row", "doc_id", "tie", "fp", "n", "counts", "slot"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            fps, sizes, hists = [], [], []
            for _, _, raw, offs in chunks(batch.column(3)):
                flat, bounds = shingle_sets(raw, offs, SHINGLE)
                total += np.bincount((flat >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                fps.append(fingerprint(flat, bounds))
                sizes.append(np.diff(bounds))
                hists += histograms(flat, bounds)
            if fps:
                found = [pa.array(np.concatenate(fps)), pa.array(np.concatenate(sizes)), pa.array(hists, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found, pa.nulls(len(batch), pa.int32())], names=names)
        if total.any():
            pieces = [p.tobytes() for p in total.astype(np.uint32).reshape(SLOTS, -1)]
            none = [pa.nulls(SLOTS, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*none, pa.array(pieces, pa.binary()), pa.array(range(SLOTS), pa.int32())], names=names)

    read = docs.table.select(F.col(docs.row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row_hash(docs.table.select(*docs.columns)).alias("tie"), "text")
    return read.mapInArrow(tidy(scan), "row long, doc_id long, tie long, fp long, n long, counts binary, slot int")


def sketch(scanned: DataFrame) -> np.ndarray:
    """Token counts by hash bucket: 2**SKETCH_BITS numbers whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(piece, np.int64 if len(piece) == (8 << SKETCH_BITS) // SLOTS else np.uint32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slot", "counts"])

    schema = "slot int, counts binary"
    pieces = scanned.where("slot is not null").select("slot", "counts")
    pieces = pieces.mapInArrow(tidy(add), schema)  # the sum of each task's pieces
    rows = pieces.repartition(SLOTS, "slot").mapInArrow(tidy(add), schema).collect()
    out = np.zeros((SLOTS, (1 << SKETCH_BITS) // SLOTS), np.int64)
    for r in rows:
        out[r["slot"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def pack(key: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray, hot: np.ndarray) -> bytes:
    """One array after another, behind their length and two flags.

    Keys keep 48 bits: tokens that agree in them share a list, which only lets
    more pairs pass.  Sizes and positions take two bytes each if all fit.
    """
    wide, some = bool((n >> 16).any()), bool(hot.any())
    kind = np.int32 if wide else np.uint16
    head = np.array([len(key), wide, some], np.int32)
    cols = [head, key.astype(np.uint32), (key >> U(32)).astype(np.uint16), fp, n.astype(kind), pos.astype(kind), *[hot] * some]
    return b"".join(c.tobytes() for c in cols)


def postings(docs: DataFrame, counts: np.ndarray, n_parts: int) -> DataFrame:
    """Prefix postings under the first order, packed by target part.

    Equal sets of one task are posted once.  The postings of a token
    with more than HOT_POSTINGS in the sketch go to several parts by their
    fingerprints, and are marked.
    """
    classes, hot = frequency_classes(counts), -(-counts // HOT_POSTINGS)
    hot = hot.astype(np.int32) if (hot > 1).any() else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                flat, bounds = shingle_sets(raw, offs, SHINGLE)
                fps, n = fingerprint(flat, bounds), np.diff(bounds)
                keys, flat_key = order_keys(flat, classes, 0), flat
                fresh = np.zeros(len(n), bool)
                if hot is not None:  # tokens in the order of their keys
                    order = np.lexsort((keys, np.repeat(np.arange(len(n)), n)))
                    keys, flat_key = keys[order], flat[order]
                for d, fp in enumerate(fps.tolist()):
                    if n[d] and fp not in seen:
                        seen.add(fp)
                        fresh[d] = True
                        keys[bounds[d] : bounds[d + 1]].sort()
                docs_at = np.flatnonzero(fresh)
                if not len(docs_at):
                    continue
                p = prefix_sizes(n[docs_at])
                take = ragged(bounds[docs_at], p)
                key, doc = keys[take], np.repeat(docs_at, p)
                pos = (take - bounds[doc]).astype(np.int32)
                lot, marked = key, np.zeros(len(key), bool)
                if hot is not None:
                    many = hot[(flat_key[take] >> U(64 - SKETCH_BITS)).astype(np.int64)]
                    lot = key + np.where(many > 1, mix(fps[doc].view(U)) % np.maximum(many, 1).astype(U), U(0))
                    marked = many > 1
                part = (lot % U(n_parts)).astype(np.int32 if n_parts > 1 << 15 else np.int16)
                order = np.argsort(part, kind="stable")
                key, doc, pos, part, marked = key[order], doc[order], pos[order], part[order], marked[order]
                cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
                size = n[doc].astype(np.int32)
                ids, blobs = part[cuts[:-1]], []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    blobs.append(pack(key[a:b], fps[doc[a:b]], size[a:b], pos[a:b], marked[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return docs.select("text").mapInArrow(tidy(post), "part int, blob binary")


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Keys, fingerprints, set sizes, positions and marks of packed postings."""
    cols: tuple[list, ...] = ([], [], [], [], [])
    for blob in blobs:
        k, wide, hot = (int(v) for v in np.frombuffer(blob, np.int32, 3))
        kind = np.int32 if wide else np.uint16
        at, found = 12, []
        for t in (np.uint32, np.uint16, np.int64, kind, kind, *[bool] * hot):
            found.append(np.frombuffer(blob, t, k, at))
            at += k * np.dtype(t).itemsize
        low, high, fp, n, pos, *marked = found
        key = low.astype(U) | (high.astype(U) << U(32))
        for c, v in zip(cols, (key, fp, n.astype(np.int32), pos.astype(np.int32), marked[0] if hot else np.zeros(k, bool))):
            c.append(v)
    return tuple(np.concatenate(c) for c in cols)


def may_pair(n1, pos1, n2, pos2):
    """Position filter at the first shared token; it implies the length filter."""
    most = np.minimum(n1 - pos1, n2 - pos2).astype(np.int64)
    return most * (NUM + DEN) >= NUM * (n1.astype(np.int64) + n2)


RUN_SCHEMA = "key long, fp long, n int, pos int, a long, b long, c int"


def runs(packed: DataFrame, n_parts: int) -> DataFrame:
    """Pairs of nodes that share prefix tokens, and the postings of long lists.

    Rows with ``a`` and ``b`` are pairs that pass the position filter in ``c``
    of a task's lists: all pairs of short lists, and of long ones each posting
    with the one before it and with the one that stands earliest in its own
    prefix.  Rows with ``key`` are the postings of long lists.
    """

    names = ["key", "fp", "n", "pos", "a", "b", "c"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [x for b in batches for x in b.column(1).to_pylist()]
        if not blobs:
            return
        key, fp, n, pos, hot = unpack(blobs)
        del blobs
        order = np.lexsort((pos, fp, key))
        key, fp, n, pos, hot = key[order], fp[order], n[order], pos[order], hot[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        key, fp, n, pos, hot = key[new], fp[new], n[new], pos[new], hot[new]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((head, [len(key)])))
        hot = np.logical_or.reduceat(hot, head)  # the rest of a hot list is in other parts
        keep = np.repeat((size > 1) | hot, size)
        key, fp, n, pos = key[keep], fp[keep], n[keep], pos[keep]
        if not len(key):
            return
        size, hot = size[(size > 1) | hot], hot[(size > 1) | hot]
        order = np.lexsort((fp, n, pos, key))
        fp, n, pos = fp[order], n[order], pos[order]
        long = np.repeat((size > SHORT_LIST) | hot, size)
        head = np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        left = head + np.repeat(size, size) - 1 - np.arange(len(fp))  # nodes after this one
        x, y = [head[long]], [np.flatnonzero(long)]
        for d in range(1, SHORT_LIST):
            at = np.flatnonzero((left >= d) & (~long | (d == 1)))
            x.append(at)
            y.append(at + d)
        x, y = np.concatenate(x), np.concatenate(y)
        meets = (x != y) & may_pair(n[x], pos[x], n[y], pos[y])
        x, y = fp[x[meets]], fp[y[meets]]
        at = np.flatnonzero(long)
        for k in range(0, len(at), 100_000):
            i = at[k : k + 100_000]
            none = pa.nulls(len(i), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[i].view(np.int64)), pa.array(fp[i]), pa.array(n[i]), pa.array(pos[i]), none, none, pa.nulls(len(i), pa.int32())], names=names)
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
        c = np.diff(np.concatenate((first, [len(a)]))).astype(np.int32)
        for k in range(0, len(first), 100_000):
            i = first[k : k + 100_000]
            none, small = pa.nulls(len(i), pa.int64()), pa.nulls(len(i), pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, small, small, pa.array(a[i]), pa.array(b[i]), pa.array(c[k : k + 100_000])], names=names)

    return packed.repartitionById(n_parts, F.col("part")).mapInArrow(tidy(gather), RUN_SCHEMA)


def can_pair(x: str, y: str) -> Column:
    """``may_pair`` of two structs of n and pos."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos")).cast("long")
    return most * (NUM + DEN) >= NUM * (F.col(f"{x}.n").cast("long") + F.col(f"{y}.n"))


def pair_of(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.fp", f"{y}.fp").alias("a"), F.greatest(f"{x}.fp", f"{y}.fp").alias("b")]


def components_of_lists(placed: DataFrame) -> DataFrame:
    """(key, comp, size, early, other) of lists: two of each component's nodes, the one earliest in its prefix and one by hash."""
    early, other = F.struct("pos", "fp", "n"), F.struct("fp", "n", "pos")  # set names are hashes
    return placed.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(early).alias("early"), F.min(other).alias("other"))


def hub_pairs(lists: DataFrame) -> DataFrame:
    """Pairs of each component's nodes with those of its list's largest component."""
    top = lists.groupBy("key").agg(F.max(F.struct("size", "comp", "early", "other")).alias("top"), F.count("*").alias("n_comps")).where("n_comps > 1")
    met = lists.join(top, "key").where("comp != top.comp")
    met = met.select(F.explode(F.array(*[F.struct(F.struct("early.fp", "early.n", "early.pos").alias("x"), F.struct(f"top.{y}.fp", f"top.{y}.n", f"top.{y}.pos").alias("y")) for y in ("early", "other")])).alias("p"))
    return met.where(can_pair("p.x", "p.y")).select(*pair_of("p.x", "p.y")).distinct()


def cross_pairs(placed: DataFrame, lists: DataFrame, n_parts: int) -> DataFrame:
    """All pairs of one list that pass the position filter and lie in different components.

    Lists that ``lists`` has as a single component are left out before anything is dealt.  A
    list's blocks meet two at a time, each meeting in a cell of its own.
    """
    mixed = lists.groupBy("key").agg(F.count("*").alias("n_comps"), F.sum("size").alias("size")).where("n_comps > 1")
    rows = placed.join(mixed.select("key", F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("blocks")), "key")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), "own", "fp", "n", "pos", "comp")
    dealt = mixed.agg(F.sum(F.col("size") * F.ceil(F.col("size") / LIST_BLOCK))).first()[0] or 0
    n_parts = max(n_parts, -(-int(dealt) // CELL_ROWS))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        """Whole cells, some at a time; the last cell of a batch waits for the next."""
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            table = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                table = [np.concatenate((x, y)) for x, y in zip(rest, table)]
            cell = np.flatnonzero(np.any([v[1:] != v[:-1] for v in table[:3]], 0)) + 1
            at = int(cell[-1]) if len(cell) else 0
            rest = [v[at:] for v in table]
            if at:
                yield [v[:at] for v in table]
        if rest is not None:
            yield rest

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        held = 0

        def flush():
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for key, x, y, own, fp, n, pos, comp in cells(batches):
            head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
            tail = np.concatenate((head[1:], [len(key)]))
            mixed = np.minimum.reduceat(comp, head) != np.maximum.reduceat(comp, head)
            for s, e in zip(head[mixed].tolist(), tail[mixed].tolist()):
                rn, rp, rc, rf, ro = n[s:e], pos[s:e], comp[s:e], fp[s:e], own[s:e]
                apart = x[s] != y[s]
                upto = np.searchsorted(rn, rn * DEN // NUM, "right")
                for i, u in enumerate(upto.tolist()):
                    meets = (rc[i + 1 : u] != rc[i]) & may_pair(rn[i], rp[i], rn[i + 1 : u], rp[i + 1 : u])
                    if apart:
                        meets &= ro[i + 1 : u] != ro[i]
                    j = np.flatnonzero(meets) + i + 1
                    if len(j):
                        out.append(np.stack((np.minimum(rf[i], rf[j]), np.maximum(rf[i], rf[j])), 1))
                        held += len(j)
                    if held > 500_000:
                        yield flush()
                        out, held = [], 0
        if out:
            yield flush()

    rows = rows.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "fp")
    return rows.mapInArrow(tidy(meet), "a long, b long").distinct()


def plausible(pairs: DataFrame, hists: DataFrame) -> DataFrame:
    """The pairs whose histograms leave the similarity possible; loses none that has it."""
    cols = [c for c in pairs.columns if c not in ("a", "b")]
    schema = "a long, b long" + "".join(f", {c} {pairs.schema[c].dataType.simpleString()}" for c in cols)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns
            keep = np.zeros(len(batch), bool)
            size = (batch.column(k - 2).to_numpy() + batch.column(k - 1).to_numpy()) * NUM
            for i, (x, y) in enumerate(zip(batch.column(k - 4), batch.column(k - 3))):
                most = most_shared(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                keep[i] = most * (NUM + DEN) >= size[i]
            yield batch.filter(pa.array(keep)).select(list(range(k - 4)))

    left = hists.select(F.col("fp").alias("a"), F.col("hist").alias("x"), F.col("n").alias("nx"))
    right = hists.select(F.col("fp").alias("b"), F.col("hist").alias("y"), F.col("n").alias("ny"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", *cols, "x", "y", "nx", "ny")
    return joined.mapInArrow(tidy(check), schema)


def node_sets(docs: Placed, wanted: DataFrame, classes: np.ndarray) -> DataFrame:
    """(fp, heads, tokens) of the sets of wanted rows: 32-bit hashes of the prefixes under the further orders, and the set."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                flat, bounds = shingle_sets(raw, offs, SHINGLE)
                further = [order_keys(flat, classes, k) for k in range(1, len(ORDERS))]
                heads, sets = [], []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    p = int(prefix_sizes(np.array([e - s]))[0])
                    heads.append(b"".join(np.partition(k[s:e], p - 1)[:p].astype(np.uint32).tobytes() for k in further))
                    sets.append(flat[s:e].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(fingerprint(flat, bounds)), pa.array(heads, pa.binary()), pa.array(sets, pa.binary())], names=["fp", "heads", "tokens"])

    return docs.only(wanted).select("text").mapInArrow(tidy(build), "fp long, heads binary, tokens binary")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two arrays without repeats have in common."""
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def checked(pairs: DataFrame, sets: DataFrame, column: str, holds) -> DataFrame:
    """The pairs (a, b) whose values of ``column`` satisfy ``holds(x, y)``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [holds(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("fp").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("fp").alias("b"), F.col(column).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(check), "a long, b long")


def share_prefixes(x, y) -> bool:
    """Whether two nodes share a prefix token under each further order; equal 32-bit hashes only let more pass."""
    x, y = (np.frombuffer(v, np.uint32).reshape(len(ORDERS) - 1, -1) for v in (x, y))
    return all(np.isin(p, q).any() for p, q in zip(x, y))


def similar(x, y) -> bool:
    x, y = np.frombuffer(x, U), np.frombuffer(y, U)
    both = shared(x, y)
    return DEN * both >= NUM * (len(x) + len(y) - both)


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()


def best_partners(near: DataFrame) -> DataFrame:
    """The pairs (a, b) of each node with those that share most of its prefix lists."""
    both = [near.select("a", "b", "c", F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    best = Window.partitionBy("node").orderBy(F.desc("c"), "other")
    return both[0].unionByName(both[1]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= FIRST_PARTNERS).select("a", "b").distinct()


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes lie in different components."""
    for end in ("a", "b"):
        of = comps.select(F.col("node").alias(end), F.col("component").alias(f"comp_{end}"))
        pairs = pairs.join(of, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    return pairs.where("comp_a != comp_b").select("a", "b")


def verified(docs: Placed, pairs: DataFrame, reps: DataFrame, classes: np.ndarray) -> DataFrame:
    """The similar ones of the pairs; their sets are made for this and go."""
    spark = docs.table.sparkSession
    wanted = common.staged(reps.join(ends(pairs), "fp", "left_semi").select("row"), "jaccard-wanted")
    sets = common.staged(node_sets(docs, wanted, classes), "jaccard-sets")
    common.release(spark)
    met_in_all = common.staged(checked(pairs, sets, "heads", share_prefixes), "jaccard-candidates")
    linked = common.staged(checked(met_in_all, sets, "tokens", similar), "jaccard-links")
    common.discard(wanted, sets, met_in_all)
    return linked


def named_rows(docs: Placed) -> DataFrame:
    """One row a document: row, doc_id, tie, fp, n, component (a set name that its similarity group shares) and group (the group's least doc_id), both null without words."""
    spark = docs.table.sparkSession
    scanned = common.staged(scan_sets(docs), "jaccard-scan")
    nodes = common.staged(scanned.where("slot is null").select("row", "doc_id", "tie", "fp", "n"), "jaccard-nodes")
    reps = scanned.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("counts").alias("hist"))
    reps = common.staged(reps, "jaccard-reps")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    n_parts = max(common.parts(spark), -(-int(total) // (5 * POSTINGS_A_PART)))
    counts = sketch(scanned) if total else np.zeros(1 << SKETCH_BITS, np.int64)
    classes = frequency_classes(counts)
    common.discard(scanned)
    common.release(spark)
    met = common.staged(runs(postings(docs.source, counts, n_parts), n_parts), "jaccard-runs")
    common.release(spark)

    posted = met.where("key is not null").select("key", "fp", "n", "pos")
    near = met.where("a is not null").groupBy("a", "b").agg(F.sum("c").alias("c"))
    near = common.staged(plausible(near, reps), "jaccard-near")
    common.release(spark)
    done = comps = lists = None
    spent, long = [met, near], not posted.isEmpty()
    for step in range(HUB_ROUNDS + 2 if long else 2):
        if step == 0:
            pairs = best_partners(near)
        else:
            last = step > HUB_ROUNDS
            fresh = []
            if long:
                placed = posted.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "pos", F.coalesce("component", "fp").alias("comp"))
                if not last or lists is None:
                    common.discard(lists)
                    lists = common.staged(components_of_lists(placed), "jaccard-lists")
                # components only merge: a list of one component stays so, and the lists of the last hub round hold all others
                met_here = cross_pairs(placed, lists, n_parts) if last else hub_pairs(lists)
                fresh.append(plausible(met_here.join(done, ["a", "b"], "left_anti"), reps))
            if step == 1:
                fresh.append(apart(near, comps).join(done, ["a", "b"], "left_anti"))
            pairs = fresh[0] if len(fresh) == 1 else fresh[0].unionByName(fresh[1]).distinct()
        pairs = common.staged(pairs, "jaccard-pairs")
        spent.append(pairs)
        done = pairs if done is None else done.unionByName(pairs)
        if step and pairs.isEmpty():
            continue
        linked = verified(docs, pairs, reps, classes)
        if step == 0 or not linked.isEmpty():
            known = linked if comps is None else linked.unionByName(comps.select(F.col("node").alias("a"), F.col("component").alias("b")))
            spent.append(comps)
            comps = common.staged(connected_components(known), "jaccard-components")
        spent.append(linked)
        common.release(spark)
    common.discard(lists, *spent)
    named = common.staged(reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "jaccard-named")
    common.discard(reps, comps)
    least = named.groupBy("component").agg(F.min("rep").alias("group"))
    by_fp = named.join(least, "component").select("fp", "component", "group")
    return nodes.join(by_fp, "fp", "left").select("row", "doc_id", "tie", "fp", "n", *[F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("component", "group")])


def similarity_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id.

    Null and empty texts and texts of white space have no shingles and link
    with nothing.  Equal sets link (similarity 1), so repeated rows share a
    group.  Null ids are the least of no group.  Texts of any length count whole.  An empty table gives no
    rows.  Extra columns are ignored.
    """
    component = F.when(F.col("n") > 0, F.col("group")).otherwise(F.col("doc_id"))
    at_hand = placed(docs.select("doc_id", "text"), "jaccard-docs")
    named = named_rows(at_hand)
    at_hand.discard()  # all that is left to do needs no texts
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(common.table(spark, sf_dir, "documents"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each similarity group: the least doc_id (null last), then the least set name and text.

    Rows are judged one by one: a doc_id that repeats with another text is a
    document of its own.  Null and empty texts and texts of white space are
    copies of nothing, so all their rows stay.  Of rows that differ in other
    columns only, the one with the least hash stays.  Columns of any name pass
    through; an empty table gives no rows.  The texts stay where they are: a
    task meets the list of rows to drop of each run of its own rows.  Only
    texts that tell two rows of one id and one set apart are compared.
    """
    at_hand = placed(docs, "near-docs")
    rows = common.staged(named_rows(at_hand).where("n > 0").drop("n", "group"), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    heads = rows.join(first, "component").where(order == F.col("first"))
    heads = common.staged(heads.groupBy("component", "tie").agg(F.min("row").alias("row")), "near-heads")
    tied = heads.groupBy("component").agg(F.count("*").alias("c")).where("c > 1")
    unlike = common.staged(heads.join(tied.select("component"), "component"), "near-tied")
    texts = at_hand.only(unlike, numbered=True).select(F.col(at_hand.row).alias("row"), "text")
    least = unlike.join(texts, "row").groupBy("component").agg(F.min(F.struct("text", "tie", "row")).alias("t")).select("component", "t.row")
    stays = heads.join(tied.select("component"), "component", "left_anti").select("component", "row").unionByName(least)
    gone = rows.select("row").join(common.staged(stays, "near-stays").select("row"), "row", "left_anti")
    return at_hand.without(common.staged(gone, "near-gone"))
