"""Whole-batch numpy kernels on UTF-8 text held in Arrow buffers."""
from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 2 << 20
#: for kernels with many values a byte: an executor's workers share what the heap leaves
SMALL_BYTES = 1 << 19


def release_memory() -> None:
    """Give freed memory back to the system: a worker that waits, or goes on to another stage, keeps none of it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that releases its memory when it starts and when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        release_memory()
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


with np.errstate(over="ignore"):
    BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15)) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown in steps of a quarter million."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = ((n >> 18) + 1) << 18
        have = np.empty(size, U)
        have[0] = 1
        k = 1
        while k < size:
            more = min(k, size - k)
            have[k : k + more] = have[:more] * U(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[: n + 1]


INVERSE = pow(BASE, -1, 1 << 64)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, 8 * column.offset)
    if data is None or data.size == 0:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: (first, end, bytes, offsets).

    A document is never cut: one longer than the limit is a run of its own.
    """
    raw, offs = text_buffer(column)
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and words per document."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    gap = np.ones(n + 2, bool)
    gap[1:-1] = SPACE[raw]
    word = ~gap[1:-1]
    starts = np.flatnonzero(word & (gap[:n] | edge[:n]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each byte span through prefix polynomial sums."""
    n = len(raw)
    sums = np.zeros(n + 1, U)
    if n:
        np.cumsum((BYTE_LOWER if lower else BYTE)[raw] * powers(BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts])


STEP = U(0xD1342543DE82EF95)
SHORT = U(0xA0761D6478BD642F)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-shingle hashes of each document, ascending, and their bounds.

    A document of fewer than ``size`` words has one shingle, its whole word
    sequence; one without words has none.
    """
    starts, ends, count = word_bounds(raw, offs)
    w = span_hashes(raw, starts, ends)
    first = np.concatenate(([0], np.cumsum(count)))
    n_docs = len(count)
    n_sh = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n_sh)))
    if not len(w):
        return np.zeros(0, U), np.zeros(n_docs + 1, np.int64)
    padded = np.concatenate((w, np.zeros(size, U)))
    h = np.zeros(len(w), U)
    for k in range(size):
        h = h * STEP + padded[k : k + len(w)]
    h = mix(h)
    keep = np.repeat(first[:-1] - at[:-1], n_sh) + np.arange(at[-1])
    out = h[keep]
    for d in np.flatnonzero((count > 0) & (count < size)):
        v = np.array([SHORT + U(count[d])])
        for x in range(first[d], first[d + 1]):
            v = v * STEP + w[x]
        out[at[d]] = mix(v)[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    doc = np.repeat(np.arange(n_docs), n_sh)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    bounds = np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=n_docs))))
    return out[new], bounds


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. for each (start, length), concatenated."""
    at = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])
