"""Benchmark decontamination: BM25 retrieval of test items by every passage.

The items form an inverted index of BM25 impacts, each divided by its item's
score for itself, so one threshold serves all.  Items are indexed by classes
of length, and the passages for a class are windows of twice its greatest
length that step by that length, so a whole item always lies within one and a
short item never meets the windows of a long one.

Pruning takes the block maxima of block-max WAND, and in place of its pivot,
which walks one passage's lists in step, terms chosen beforehand: a passage
first looks at an item only through a term without which the item's other
terms cannot reach the threshold, then bounds each block of items by the
block's greatest impacts, and scores the items of the blocks that remain.
What passes is verified: word trigrams of the question and of the answer must
both lie in the passage.  A part of one or two words is one gram of that many
words; an item of one word is its own answer.

The index is what is broadcast.  It holds items of INDEX_BYTES at most (or one
longer item); a larger benchmark is dealt into slices, whose passes over the
documents follow one another.  Weights are those of all items, so slices do
not change a score.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnp import SMALL_BYTES, STEP, U, chunks, mix, ragged, release_memory, span_hashes, text_buffer, tidy

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
BLOCK = 16
GRAM = 3
#: text of the items that one index holds
INDEX_BYTES = 4 << 20
#: words of the shortest class of items; each next class is twice as long
SHORTEST = 32

LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def term_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of letters and digits, lower-cased, and bounds by text."""
    n = len(raw)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = ~LETTER[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    word = ~gap[1:-1]
    starts = np.flatnonzero(word & (gap[:n] | edge[:n]))
    ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offs)


def grams(h: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of the word n-grams of a sequence; a shorter one is one gram."""
    size = min(size, len(h))
    if not size:
        return np.zeros(0, U)
    k = len(h) - size + 1
    out = np.zeros(k, U)
    for i in range(size):
        out = out * STEP + h[i : i + k]
    return mix(out)


@dataclass
class Index:
    """Sorted terms, impacts by (item, term), block maxima, essential postings, and gram size and grams by part."""

    item_ids: np.ndarray
    terms: np.ndarray
    stride: int
    pair_keys: np.ndarray
    pair_impact: np.ndarray
    block_keys: np.ndarray
    block_max: np.ndarray
    essential_at: np.ndarray
    essential_items: np.ndarray
    question: list[tuple[int, np.ndarray]]
    answer: list[tuple[int, np.ndarray]]


@dataclass
class Totals:
    """Figures of the whole test set: items by term (of the terms at hand), items, and mean length in words."""

    terms: np.ndarray
    df: np.ndarray
    n: int
    mean: float


def build(ids: list[int], h: np.ndarray, bounds: np.ndarray, whole: Totals) -> Index:
    """The index of some items with words, weighed by the whole test set; an item is ordered beside those of its length."""
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    seqs = [h[bounds[i] : bounds[i + 1]] for i in order]
    terms = np.unique(np.concatenate(seqs)) if seqs else np.zeros(0, U)
    n, t = len(seqs), len(terms)
    item = np.repeat(np.arange(n), [len(s) for s in seqs])
    key = item * max(1, t) + np.searchsorted(terms, np.concatenate(seqs) if seqs else terms)
    keys, tf = np.unique(key, return_counts=True)
    item, term = keys // max(1, t), keys % max(1, t)
    df = whole.df[np.searchsorted(whole.terms, terms)]
    idf = np.log(1 + (whole.n - df + 0.5) / (df + 0.5))
    length = np.array([len(s) for s in seqs], float)
    norm = K1 * (1 - B + B * length / max(1.0, whole.mean))
    impact = idf[term] * tf * (K1 + 1) / (tf + norm[item]) if n else np.zeros(0)
    impact = impact / np.bincount(item, impact, n)[item]
    block_key = (item // BLOCK) * max(1, t) + term
    bo = np.argsort(block_key, kind="stable")
    block_keys, first = np.unique(block_key[bo], return_index=True)
    block_max = np.maximum.reduceat(impact[bo], first) if n else np.zeros(0)
    # the commonest terms of an item that stay below the threshold together are not essential
    by_df = np.lexsort((term, -df[term], item))
    run = np.cumsum(impact[by_df])
    head = np.searchsorted(item[by_df], np.arange(n))
    before = run - impact[by_df]
    inside = run - before[head][item[by_df]]
    ess = by_df[inside >= THRESHOLD]
    ess = ess[np.lexsort((item[ess], term[ess]))]
    essential_at = np.searchsorted(term[ess], np.arange(t + 1))
    cut = [len(s) - max(1, len(s) // 3) if len(s) > 1 else 1 for s in seqs]
    parts = [(s[:c], s[c:] if len(s) > 1 else s) for s, c in zip(seqs, cut)]
    return Index(
        np.array([ids[i] for i in order], np.int64), terms, max(1, t), keys, impact, block_keys, block_max, essential_at, item[ess],
        *([(min(GRAM, len(p)), np.unique(grams(p))) for p in side] for side in (list(zip(*parts)) or [(), ()])),
    )


def lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], 0.0)


def search(index: Index, step: int, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(document, item, score, question overlap, answer overlap) of verified passages, the best of each pair."""
    if not len(index.terms):
        return []
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == h)
    n_words = np.diff(bounds)
    n_win = np.maximum(1, -(-n_words // step) - 1) * (n_words > 0)
    win0 = np.cumsum(n_win) - n_win
    doc = np.searchsorted(bounds, known, "right") - 1
    slot = (known - bounds[doc]) // step
    wins = []
    for back in (0, 1):
        w = slot - back
        ok = (w >= 0) & (w < n_win[doc])
        wins.append((win0[doc[ok]] + w[ok]) * index.stride + at[known[ok]])
    pair = np.unique(np.concatenate(wins))
    win, term = pair // index.stride, pair % index.stride
    # items that an essential term of the passage names
    many = index.essential_at[term + 1] - index.essential_at[term]
    hit = np.flatnonzero(many)
    items = index.essential_items[ragged(index.essential_at[term[hit]], many[hit])]
    n_items = len(index.item_ids)
    cand = np.unique(np.repeat(win[hit], many[hit]) * n_items + items)
    if not len(cand):
        return []
    first = np.searchsorted(win, np.arange(int(n_win.sum()) + 1))
    n_blocks = -(-n_items // BLOCK)
    blocks = np.unique(cand // n_items * n_blocks + cand % n_items // BLOCK)

    def total(owner: np.ndarray, windows: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(owner))
        for a in range(0, len(owner), 20_000):
            w = windows[a : a + 20_000]
            size = first[w + 1] - first[w]
            t = term[ragged(first[w], size)]
            who = np.repeat(np.arange(len(w)), size)
            out[a : a + len(w)] = np.bincount(who, lookup(keys, values, owner[a : a + 20_000][who] * index.stride + t), len(w))
        return out

    bound = total(blocks % n_blocks, blocks // n_blocks, index.block_keys, index.block_max)
    blocks = blocks[bound >= THRESHOLD - 1e-9]
    cand = cand[np.isin(cand // n_items * n_blocks + cand % n_items // BLOCK, blocks)]
    score = total(cand % n_items, cand // n_items, index.pair_keys, index.pair_impact)
    passed = np.flatnonzero(score >= THRESHOLD - 1e-9)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    seen, have = -1, {}
    for c, s in zip(cand[passed].tolist(), score[passed].tolist()):
        w, i = divmod(c, n_items)
        d = int(np.searchsorted(win0, w, "right")) - 1
        while n_win[d] == 0:
            d -= 1
        a = bounds[d] + (w - win0[d]) * step
        if w != seen:
            seen, have = w, {}
        for size in {index.question[i][0], index.answer[i][0]} - have.keys():
            have[size] = grams(h[a : min(bounds[d + 1], a + 2 * step)], size)
        q, r = (float(np.isin(part, have[size]).mean()) for size, part in (index.question[i], index.answer[i]))
        if q >= OVERLAP and r >= OVERLAP and (s, q, r) > best.get((d, i), (-1.0,)):
            best[d, i] = (s, q, r)
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def by_length(ids: list[int], texts: list[str], whole: Totals) -> list[tuple[Index, int]]:
    """An index for each class of length, with the step of its windows."""
    h, bounds = term_spans(*text_buffer(pa.array(texts, pa.large_string())))
    size = np.diff(bounds)
    step = SHORTEST << np.ceil(np.log2(np.maximum(size, SHORTEST) / SHORTEST)).astype(np.int64)
    out = []
    for k in np.unique(step[size > 0]).tolist():
        own = np.flatnonzero((step == k) & (size > 0))
        part = np.concatenate([h[bounds[i] : bounds[i + 1]] for i in own])
        out.append((build([ids[i] for i in own], part, np.concatenate(([0], np.cumsum(size[own]))), whole), k))
    return out


def slices(benchmark: DataFrame) -> Iterator[list[tuple[Index, int]]]:
    """The indexes of one slice of the items after another.

    Spark counts the items of each term; the driver holds one slice and the
    counts of its terms.  Null or wordless items and null ids match nothing;
    items that repeat count once.
    """
    spark = benchmark.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds = term_spans(*text_buffer(batch.column(1)))
            lists = [np.unique(h[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(bounds)), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "text", "n", "terms"])

    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = common.staged(items.mapInArrow(read, "item_id long, text string, n long, terms array<long>").where("n > 0"), "benchmark-items")
    size = items.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["n"]:
        return
    parts = -(-size["bytes"] // INDEX_BYTES)
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    terms = items.select("slice", F.explode("terms").alias("term"))
    df = common.staged(terms.groupBy("term").agg(F.count("*").alias("df")), "benchmark-terms")
    for k in range(parts):
        own = items.where(F.col("slice") == k).select("item_id", "text").orderBy("item_id", "text").toArrow()
        if len(own):
            count = df.join(terms.where(F.col("slice") == k).select("term").distinct(), "term").toArrow()
            key = count.column("term").to_numpy().view(U)
            order = np.argsort(key)
            whole = Totals(key[order], count.column("df").to_numpy()[order], size["n"], size["mean"])
            yield by_length(own.column("item_id").to_pylist(), own.column("text").to_pylist(), whole)
    common.discard(items, df)


def found_in(index: list[tuple[Index, int]], column: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap) of a slice's items in whole texts."""
    for a, _, raw, offs in chunks(column, SMALL_BYTES):
        h, bounds = term_spans(raw, offs)
        for part, step in index:
            for d, i, *figures in search(part, step, h, bounds):
                yield (a + d, int(part.item_ids[i]), *figures)


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of leaked items.

    Null and empty texts hold none; texts of any length are searched whole;
    repeated rows give equal rows once each; an empty table on either side
    gives no rows; extra columns are ignored.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def search_with(index: list[tuple[Index, int]]) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if rows := list(found_in(index, batch.column(1))):
                    d, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *map(pa.array, rest)], names=names)

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(scan), SCHEMA)

    out = last = None
    for index in slices(benchmark):
        if last is not None:
            last = common.staged(last, "leaks")
            out = last if out is None else out.unionByName(last)
        last = search_with(index)
    if last is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return last if out is None else out.unionByName(last)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""

    def holds(index: list[tuple[Index, int]]) -> Column:
        @F.arrow_udf("boolean")
        def leaked(column: pa.Array) -> pa.Array:
            out = np.zeros(len(column), bool)
            for row in found_in(index, column):
                out[row[0]] = True
            release_memory()  # the worker may wait through later stages
            return pa.array(out)

        return leaked(F.col("text"))

    first = True
    for index in slices(benchmark):
        docs = (docs if first else common.staged(docs, "leaks-kept")).where(~holds(index))
        first = False
    return docs


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Rows are judged one by one, whatever their ids.  Null and empty texts hold
    no item and stay; repeated rows are judged alike; texts of any length are
    searched whole; columns of any name pass through; an empty table gives no
    rows, and an empty benchmark keeps all.
    """
    return without_leaks(docs, common.table(spark, sf_dir, "benchmark"))
