"""Removal of byte strings that an earlier document holds, by sorted suffixes.

Every 50-byte string has one anchor: its 20-byte gram of least hash, the
leftmost at a tie.  Equal strings have equal anchors, so a first exchange of
anchor hashes alone tells which places can hold a repeated string.  Only those
places send their bytes, to the part of their anchor, where the suffixes that
start the strings are sorted.

The sort is a mergesort whose comparisons look at no run of bytes: prefix
polynomial hashes give the hash of any substring in constant time, and binary
search over the length finds the common extension of two suffixes.  Suffixes
that the hashes call equal over 50 bytes are then compared byte by byte.

Within a task, an anchor that recurs is announced and not sent again, and of
occurrences with equal surroundings only those of the least doc_id so far are
sent.  So a string that a third of all documents share reaches another task a
few times for each task, however many documents and chunks the task holds.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnp import BASE, BYTE, INVERSE, U, chunks, mix, powers, ragged

SPAN = 50
GRAM = 20
REACH = SPAN - GRAM + 1
#: anchors are compared by the upper bits of their hash, then by place
PLACE_BITS = 28
SLICE = 400_000
#: text for a part: what a task holds does not follow the table's size
PART_BYTES = 32 << 20
#: slots of the sketch by which a task tells what recurs in it, and surroundings that it keeps at most
RECUR_BITS = 24
KEEP = 200_000
ZSTD = pa.Codec("zstd", compression_level=1)


class Recurring:
    """What a task has met in several chunks: sorted 64-bit keys, each with a value.

    A key is kept from its third chunk on, as a sketch of small counts tells;
    a key that the sketch takes for another costs memory and nothing else.
    """

    def __init__(self, kind):
        self.counts = np.zeros(1 << RECUR_BITS, np.uint8)
        self.keys, self.values = np.zeros(0, U), np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for those not kept."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def due(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key of a chunk, none kept yet, has been met often enough; counts them."""
        slot = (keys >> U(64 - RECUR_BITS)).astype(np.int64)
        seen = self.counts[slot]
        self.counts[slot] = np.minimum(seen, 254) + 1
        return seen >= 2

    def keep(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, first = np.unique(np.concatenate((self.keys, keys)), return_index=True)
        self.keys, self.values = keys, np.concatenate((self.values, values))[first]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(BYTE[raw] * powers(BASE, len(raw))[: len(raw)], out=sums[1:])
    return sums


def row_hash(sums: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """32-bit hash of each whole text; with doc_id it names a row."""
    whole = (sums[offs[1:]] - sums[offs[:-1]]) * powers(INVERSE, int(offs[-1]))[offs[:-1]]
    return (mix(whole) >> U(32)).astype(np.uint32)


def anchors(raw: np.ndarray, offs: np.ndarray, sums: np.ndarray):
    """(document, place, first string, last string, gram hash) of each anchor.

    Places are bytes of ``raw``; an anchor serves the strings that start from
    its first to its last string.
    """
    n = len(raw)
    if n >> PLACE_BITS:
        raise ValueError(f"a text of {n} bytes is longer than {1 << PLACE_BITS}")
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none, np.zeros(0, U)
    k = n - GRAM + 1
    gram = mix((sums[GRAM:] - sums[:k]) * powers(INVERSE, n)[:k])
    mask = U((1 << PLACE_BITS) - 1)
    low = (gram & ~mask) | np.arange(k, dtype=U)
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(REACH - 16)], low[REACH - 16 :])
    # strings that cross the end of their document are none
    ends = np.repeat(offs[1:], np.diff(offs))[: len(low)]
    starts = np.flatnonzero(np.arange(len(low)) + SPAN <= ends)
    if not len(starts):
        return none, none, none, none, np.zeros(0, U)
    place = (low[starts] & mask).astype(np.int64)
    doc = np.searchsorted(offs, starts, "right") - 1
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))))
    tail = np.concatenate((head[1:], [len(place)])) - 1
    place = place[head]
    return doc[head], place, starts[head], starts[tail], gram[place]


def part_column(doc_id: Column, n: int) -> Column:
    mixed = doc_id.bitwiseXOR(F.shiftright(doc_id, 9)).bitwiseXOR(F.shiftright(doc_id, 21))
    return F.pmod(F.coalesce(mixed, F.lit(0)), F.lit(n)).cast("int")


def part_of(doc_id: np.ndarray, n: int) -> np.ndarray:
    return ((doc_id ^ (doc_id >> 9) ^ (doc_id >> 21)) % n).astype(np.int32)


def pack(part: np.ndarray, columns: list[np.ndarray], extra: bytes = b"", sizes: np.ndarray | None = None):
    """(part ids, blobs): the columns' rows of each part, one array after another.

    ``extra`` holds ``sizes`` bytes for each row, which follow compressed.
    """
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    if sizes is not None:
        at = np.cumsum(sizes) - sizes
        flat = np.frombuffer(extra, np.uint8)[ragged(at[order], sizes[order])]
        ends = np.concatenate(([0], np.cumsum(sizes[order])))
    cuts = np.concatenate((np.flatnonzero(np.diff(part, prepend=-1)), [len(part)]))
    blobs = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        blob = [c[a:b].tobytes() for c in columns]
        if sizes is not None:
            piece = flat[ends[a] : ends[b]].tobytes()
            blob.append(len(piece).to_bytes(8, "little") + ZSTD.compress(piece, asbytes=True))
        blobs.append(int(b - a).to_bytes(8, "little") + b"".join(blob))
    return part[cuts[:-1]].astype(np.int32), blobs


def unpack(blobs: list[bytes], kinds: list) -> list[np.ndarray]:
    """The columns of packed blobs; bytes that follow come as a last column."""
    cols: list[list[np.ndarray]] = [[] for _ in kinds] + [[]]
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for c, kind in zip(cols, kinds):
            c.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        if at < len(blob):
            size = int.from_bytes(blob[at : at + 8], "little")
            cols[-1].append(np.frombuffer(ZSTD.decompress(blob[at + 8 :], size, asbytes=True), np.uint8))
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(cols, [*kinds, np.uint8])]


def emit(kind: int, part: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


PACKED = "part int, kind int, blob binary"
ENTRY = [U, np.int64, np.uint32, np.int32]
PLACE = [np.int64, np.uint32, np.int32]
RANGE = [np.int64, np.uint32, np.int32, np.int32]
ASK = [U, np.int64, np.uint32, np.int32, np.uint8, np.uint8]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id with 0 for null, whether null)."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(), missing


def shared_places(docs: DataFrame, n: int) -> DataFrame:
    """Packed (doc_id, row hash, place) of anchors that several rows hold."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring = Recurring(bool)  # anchors sent before, and whether another task can tell that they are several
        for batch in batches:
            ids, missing = ids_of(batch.column(0))
            for a, b, raw, offs in chunks(batch.column(1)):
                sums = prefix_sums(raw)
                doc, place, _, _, gram = anchors(raw, offs, sums)
                here = ~missing[a:b][doc]
                doc, place, gram = doc[here], place[here], gram[here]
                if not len(doc):
                    continue
                row = row_hash(sums, offs)[doc]
                pos = (place - offs[doc]).astype(np.int32)
                did = ids[a:b][doc]
                order = np.argsort(gram, kind="stable")
                g, d = gram[order], doc[order]
                head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                size = np.diff(np.concatenate((head, [len(g)])))
                distinct = g[head]
                twice = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
                at = recurring.find(distinct)
                again = at >= 0
                told = again & recurring.values[at] if again.any() else again
                several = np.repeat(twice | again, size)
                known = order[several]
                single = order[~several]
                marks = distinct[(twice | again) & ~told]
                recurring.values[at[again]] = True
                due = np.flatnonzero(~again)[recurring.due(distinct[~again])]
                recurring.keep(distinct[due], twice[due])
                if len(known):
                    known.sort()
                    yield emit(1, *pack(part_of(did[known], n), [did[known], row[known], pos[known]]))
                single.sort()
                k = len(marks)
                cols = [
                    np.concatenate((gram[single], marks)), np.concatenate((did[single], np.zeros(k, np.int64))),
                    np.concatenate((row[single], np.zeros(k, np.uint32))), np.concatenate((pos[single], np.full(k, -1, np.int32))),
                ]
                yield emit(0, *pack((cols[0] % U(n)).astype(np.int32), cols))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            own = batch.column(1).to_numpy() == 0
            blobs += batch.column(2).filter(pa.array(own)).to_pylist()
            if not own.all():  # settled by the sender; only passes through
                yield batch.filter(pa.array(~own))
        if not blobs:
            return
        gram, did, row, pos, _ = unpack(blobs, ENTRY)
        del blobs
        order = np.argsort(gram, kind="stable")
        gram, did, row, pos = gram[order], did[order], row[order], pos[order]
        head = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        size = np.diff(np.concatenate((head, [len(gram)])))
        several = (np.minimum.reduceat(did, head) != np.maximum.reduceat(did, head)) | ((np.minimum.reduceat(pos, head) < 0) & (size > 1))
        hit = np.repeat(several, size) & (pos >= 0)
        if hit.any():
            yield emit(1, *pack(part_of(did[hit], n), [did[hit], row[hit], pos[hit]]))

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(send, PACKED)
    return sent.repartitionById(n, F.col("part")).mapInArrow(match, PACKED)


def beside_texts(docs: DataFrame, packed: DataFrame, n: int) -> DataFrame:
    """Packed rows and the texts of their documents in one part, packed rows first."""
    key = F.col("doc_id").cast("long")
    texts = docs.select(part_column(key, n).alias("part"), F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("blob"), key.alias("doc_id"), "text")
    rest = packed.select("part", "kind", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return texts.unionAll(rest).repartitionById(n, F.col("part")).sortWithinPartitions("kind")


def split_kinds(batches: Iterator[pa.RecordBatch], kinds: list):
    """The packed columns of a part, then its text batches."""
    blobs: list[bytes] = []
    held = None
    for batch in batches:
        text = batch.column(1).to_numpy() == 2
        if not text.all():
            blobs += batch.column(2).filter(pa.array(~text)).to_pylist()
        if text.any():
            if held is None:
                held = unpack(blobs, kinds)
                blobs = []
            yield held, batch.filter(pa.array(text))


def place_keys(did: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return mix(mix(did.view(U)) ^ ((row.astype(U) << U(32)) | pos.astype(np.uint32).astype(U)))


def surroundings(sums: np.ndarray, first: np.ndarray, size: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A hash of each occurrence's bytes and of its anchor's place in them."""
    return mix((sums[first + size] - sums[first]) * powers(INVERSE, len(sums) - 1)[first]) ^ mix((back * 128 + size).astype(U))


def settled(raw: np.ndarray, inner: np.ndarray, first: np.ndarray, size: np.ndarray, did: np.ndarray) -> np.ndarray:
    """Whether another occurrence of smaller doc_id has equal surroundings.

    All strings of such an occurrence are covered, and its fellow of least
    doc_id stands for it.  Equality is by hash, then byte by byte.
    """
    order = np.lexsort((did, inner))
    s = inner[order]
    head = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    least = order[np.repeat(head, np.diff(np.concatenate((head, [len(s)]))))]
    later = np.flatnonzero(did[order] > did[least])
    out = np.zeros(len(did), bool)
    for k in range(0, len(later), 50_000):
        x, y = order[later[k : k + 50_000]], least[later[k : k + 50_000]]
        width = np.minimum(size[x], size[y])
        unlike = raw[ragged(first[x], width)] != raw[ragged(first[y], width)]
        out[x] = ~(np.add.reduceat(unlike, np.cumsum(width) - width) > 0)
    return out


def repeated_ranges(docs: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """Packed (doc_id, row hash, start, end) of the bytes to remove."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None
        recurring = Recurring(np.int64)  # surroundings sent before: places in the two lists
        least: list[int] = []
        bytes_of: list[bytes] = []
        for held, batch in split_kinds(batches, PLACE):
            if keys is None:
                keys = np.unique(place_keys(*held[:3]))
            if not len(keys):
                continue
            ids, missing = ids_of(batch.column(3))
            for a, b, raw, offs in chunks(batch.column(4)):
                sums = prefix_sums(raw)
                doc, place, first, last, gram = anchors(raw, offs, sums)
                row = row_hash(sums, offs)[doc]
                did = ids[a:b][doc]
                want = place_keys(did, row, (place - offs[doc]).astype(np.int32))
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                hit = (keys[at] == want) & ~missing[a:b][doc]
                doc, place, first, last, gram, row, did = (x[hit] for x in (doc, place, first, last, gram, row, did))
                if not len(doc):
                    continue
                size = last - first + SPAN
                inner = surroundings(sums, first, size, place - first)
                done = settled(raw, inner, first, size, did)
                rest = np.flatnonzero(~done)
                at = recurring.find(inner[rest])
                for i, k in zip(rest[at >= 0].tolist(), recurring.values[at[at >= 0]].tolist()):
                    if raw[first[i] : first[i] + size[i]].tobytes() == bytes_of[k]:
                        if did[i] > least[k]:
                            done[i] = True
                        least[k] = min(least[k], int(did[i]))
                fresh = rest[at < 0]
                fresh = fresh[recurring.due(inner[fresh])][: max(0, KEEP - len(least))]
                recurring.keep(inner[fresh], len(least) + np.arange(len(fresh)))
                least += did[fresh].tolist()
                bytes_of += [raw[a : a + w].tobytes() for a, w in zip(first[fresh].tolist(), size[fresh].tolist())]
                done, rest = np.flatnonzero(done), np.flatnonzero(~done)
                start = (first - offs[doc]).astype(np.int32)
                if len(done):
                    yield emit(1, *pack(part_of(did[done], n), [did[done], row[done], start[done], (start + size)[done].astype(np.int32)]))
                width = size[rest]
                data = raw[ragged(first[rest], width)].tobytes()
                cols = [gram[rest], did[rest], row[rest], start[rest], (last - first + 1)[rest].astype(np.uint8), (place - first)[rest].astype(np.uint8)]
                yield emit(0, *pack((gram[rest] % U(n)).astype(np.int32), cols, data, width))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            own = batch.column(1).to_numpy() == 0
            blobs += batch.column(2).filter(pa.array(own)).to_pylist()
            if not own.all():
                yield batch.filter(pa.array(~own))
        if not blobs:
            return
        gram, did, row, start, n_str, back, data = unpack(blobs, ASK)
        del blobs
        width = n_str.astype(np.int64) + SPAN - 1
        at = np.cumsum(width) - width
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        load = np.cumsum(n_str[order].astype(np.int64))
        a = 0
        while a < len(head):  # slices of whole groups
            base = load[head[a] - 1] if head[a] else 0
            b = int(np.searchsorted(load[np.concatenate((head[1:], [len(g)]))[a:] - 1], base + SLICE, "right")) + a
            b = max(a + 1, b)
            r = order[head[a] : head[b] if b < len(head) else len(g)]
            a = b
            w = width[r]
            some = data[ragged(at[r], w)]
            sums = prefix_sums(some)
            place = np.cumsum(w) - w
            done = settled(some, surroundings(sums, place, w, back[r].astype(np.int64)), place, w, did[r])
            if done.any():
                q = r[done]
                yield emit(1, *pack(part_of(did[q], n), [did[q], row[q], start[q], (start[q] + width[q]).astype(np.int32)]))
            left = ~done
            r = r[left]
            which, lo, hi = covered(gram[r], did[r], n_str[r].astype(np.int64), back[r].astype(np.int64), some, place[left], sums)
            if len(which):
                q = r[which]
                yield emit(1, *pack(part_of(did[q], n), [did[q], row[q], (start[q] + lo).astype(np.int32), (start[q] + hi + SPAN).astype(np.int32)]))

    asked = beside_texts(docs, places, n).mapInArrow(ask, PACKED)
    return asked.repartitionById(n, F.col("part")).mapInArrow(answer, PACKED)


def covered(gram: np.ndarray, did: np.ndarray, n_str: np.ndarray, back: np.ndarray, data: np.ndarray, at: np.ndarray, sums: np.ndarray):
    """Runs (request, first string, last string) that a smaller doc_id also holds."""
    none = np.zeros(0, np.int64)
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = np.zeros(len(g), bool)
    if len(g) > 1:
        same[1:] = g[1:] == g[:-1]
        same[:-1] |= g[1:] == g[:-1]
    keep = np.sort(order[same])  # a gram with one request left has no partner
    if not len(keep):
        return none, none, none
    gram, did, n_str, back, at = (v[keep] for v in (gram, did, n_str, back, at))
    request = np.repeat(np.arange(len(gram)), n_str)
    string = np.arange(len(request)) - np.repeat(np.cumsum(n_str) - n_str, n_str)
    where = at[request] + string
    ahead = back[request] - string  # from the string's start to its anchor
    # a string whose hash no other has is neither covered nor covers
    whole = (sums[where + SPAN] - sums[where]) * powers(INVERSE, len(data))[where]
    slot = (mix(whole) >> U(42)).astype(np.int64)
    live = np.flatnonzero(np.bincount(slot, minlength=1 << 22)[slot] > 1)
    if not len(live):
        return none, none, none
    order = live[np.lexsort((ahead[live], gram[request[live]]))]
    g, h = gram[request[order]], ahead[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))
    segment = np.cumsum(new) - 1
    several = np.bincount(segment)[segment] > 1
    order, segment = order[several], segment[several]
    if not len(order):
        return none, none, none
    order, equal = sort_suffixes(data, sums, where, whole, order, segment)
    head = np.flatnonzero(~equal)
    size = np.diff(np.concatenate((head, [len(order)])))
    least = np.repeat(np.minimum.reduceat(did[request[order]], head), size)
    hit = np.sort(order[did[request[order]] > least])
    if not len(hit):
        return none, none, none
    req, s = request[hit], string[hit]
    head = np.flatnonzero(np.concatenate(([True], (req[1:] != req[:-1]) | (s[1:] != s[:-1] + 1))))
    tail = np.concatenate((head[1:], [len(hit)])) - 1
    return keep[req[head]], s[head], s[tail]


def sort_suffixes(data: np.ndarray, sums: np.ndarray, where: np.ndarray, whole: np.ndarray, order: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of suffixes ``where[order]`` over SPAN bytes inside each segment.

    ``sums`` are the prefix sums of ``data`` and ``whole`` the hash of SPAN
    bytes of each suffix.  Returns the sorted order and, for each place, whether its suffix equals the
    one before it in the segment, verified byte by byte.
    """
    inverse = powers(INVERSE, len(data))

    def sub(i: np.ndarray, size) -> np.ndarray:
        return (sums[i + size] - sums[i]) * inverse[i]

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x precedes suffix y: common extension by binary search."""
        out = np.zeros(len(x), bool)
        differ = np.flatnonzero(whole[x] != whole[y])
        if len(differ):
            i, j = where[x[differ]], where[y[differ]]
            lo, hi = np.zeros(len(i), np.int64), np.full(len(i), SPAN - 1)
            for _ in range((SPAN - 1).bit_length()):
                mid = (lo + hi + 1) >> 1
                same = sub(i, mid) == sub(j, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            out[differ] = data[i + lo] < data[j + lo]
        return out

    seg_first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    seg_size = np.diff(np.concatenate((seg_first, [len(segment)])))
    # a segment whose suffixes all equal its first is sorted as it stands
    unlike = whole[order] != np.repeat(whole[order[seg_first]], seg_size)
    seg_size = np.where(np.add.reduceat(unlike, seg_first) > 0, seg_size, 1)
    full = np.diff(np.concatenate((seg_first, [len(segment)])))
    begin, size = np.repeat(seg_first, full), np.repeat(seg_size, full)
    place = np.arange(len(order))
    width = 1
    while width < seg_size.max():
        live = np.flatnonzero(size > width)
        p = place[live] - begin[live]
        run = p // width
        mate = run ^ 1
        lo = begin[live] + mate * width
        hi = np.minimum(lo + width, begin[live] + size[live])
        lo = np.minimum(lo, hi)
        left = run % 2 == 0
        base = lo.copy()
        me = order[live]
        for _ in range(width.bit_length()):
            open_ = lo < hi
            mid = np.minimum((lo + hi) >> 1, len(order) - 1)
            other = order[mid]
            # a left element passes strictly smaller ones, a right one also equals
            after = np.where(left, less(other, me), ~less(me, other)) & open_
            lo = np.where(after, mid + 1, lo)
            hi = np.where(open_ & ~after, mid, hi)
        target = begin[live] + (run // 2) * 2 * width + p % width + (lo - base)
        order[target] = me
        width *= 2
    equal = np.zeros(len(order), bool)
    equal[1:] = (segment[1:] == segment[:-1]) & (whole[order[1:]] == whole[order[:-1]])
    views = np.lib.stride_tricks.sliding_window_view(data, SPAN)
    at = np.flatnonzero(equal)
    for k in range(0, len(at), 50_000):
        i = at[k : k + 50_000]
        equal[i] = (views[where[order[i]]] == views[where[order[i - 1]]]).all(1)
    return order, equal


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicate(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row a document: what remains after removal of repeated strings.

    Null text is empty.  Rows of one doc_id never remove from each other;
    a null doc_id neither removes nor loses bytes.  Texts under 50 bytes stay
    whole.  ``kept`` (binary, as a cut may split a character) comes with
    ``keep_text``.  Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(common.parts(spark), -(-size // PART_BYTES))
    places = common.staged(shared_places(docs, n), "suffix-places")
    common.release(spark)
    ranges = common.staged(repeated_ranges(docs, places, n), "suffix-ranges")
    common.discard(places)
    common.release(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple[int, int], tuple[int, int]] = {}
        ready = False
        for held, batch in split_kinds(batches, RANGE):
            if not ready:
                did, row, start, end, _ = held
                order = np.lexsort((start, row, did))
                did, row, start, end = did[order], row[order], start[order], end[order]
                new = np.flatnonzero(np.concatenate(([True], (did[1:] != did[:-1]) | (row[1:] != row[:-1])))) if len(did) else np.zeros(0, int)
                stop = np.concatenate((new[1:], [len(did)])).astype(int)
                index = {(int(did[i]), int(row[i])): (i, j) for i, j in zip(new.tolist(), stop.tolist())}
                ready = True
            ids, missing = ids_of(batch.column(3))
            out: list[tuple] = []
            for a, b, raw, offs in chunks(batch.column(4)):
                rows = row_hash(prefix_sums(raw), offs).tolist()
                for d in range(b - a):
                    text = raw[offs[d] : offs[d + 1]]
                    hit = None if missing[a + d] else index.get((int(ids[a + d]), rows[d]))
                    spans = removed = 0
                    if hit:
                        edge = np.zeros(len(text) + 1, np.int32)
                        np.add.at(edge, start[hit[0] : hit[1]], 1)
                        np.add.at(edge, end[hit[0] : hit[1]], -1)
                        gone = np.cumsum(edge[:-1]) > 0
                        removed = int(gone.sum())
                        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                        kept = text[~gone].tobytes()
                    else:
                        kept = text.tobytes()
                    out.append((None if missing[a + d] else int(ids[a + d]), len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            cols = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    return beside_texts(docs, ranges, n).mapInArrow(cut, OUT + ", kept binary" * keep_text)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"))
