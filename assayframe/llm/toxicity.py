"""Toxicity scores by a factorization machine over hashed terms.

Score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i
marks the presence of a hashed term.  The pair term lets a word count for more
beside another (an insult beside a group's mention) than the two do alone.

Every hashed term of the labelled sample that two documents hold has a weight
and factors.  Weight decay follows the evidence: a term that tells the labels
apart alone is hardly held back, one that does not is held back much, but its
factors less, so that it can still tell in a pair.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality import gathered, labelled_sample
from .textnp import chunks, span_hashes

CUT = 0.5
SAMPLE_ROWS = 20_000
HASH_BITS = 22
#: documents of the sample that hold a term of the machine
LEAST_DOCS = 2
FACTORS = 6
#: chi-square at which a term is decayed as given, and the most that weights and factors are decayed beyond
EVIDENCE = 12.0
MOST_WEIGHT_DECAY, MOST_FACTOR_DECAY = 1000.0, 30.0
#: presences of terms handled at once
BLOCK = 1 << 18

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each whole text and their bounds.

    A term is a run of letters (bytes beyond ASCII included), lower-cased.
    """
    out, count = [], np.zeros(len(column), np.int64)
    for a, b, raw, offs in chunks(column):
        n = len(raw)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = ~LETTER[raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        word = ~gap[1:-1]
        starts = np.flatnonzero(word & (gap[:n] | edge[:n]))
        ends = np.flatnonzero(word & (gap[2:] | edge[1:])) + 1
        h = (span_hashes(raw, starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        doc = np.searchsorted(offs, starts, "right") - 1
        both = np.unique((doc << HASH_BITS) | h)
        out.append((both & ((1 << HASH_BITS) - 1)).astype(np.int32))
        count[a:b] = np.bincount(both >> HASH_BITS, minlength=b - a)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(count)))


@dataclass
class Machine:
    """Fitted terms (ascending), linear weights, factors and bias."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    b: float

    def score(self, column: pa.Array) -> np.ndarray:
        flat, bounds = terms(column)
        n = len(bounds) - 1
        at = np.searchsorted(self.terms, flat)
        hit = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == flat) if len(self.terms) else np.zeros(0, int)
        doc, term = np.searchsorted(bounds, hit, "right") - 1, at[hit]
        z = self.b + np.bincount(doc, self.w[term], n)
        for f in range(self.v.shape[1]):
            v = self.v[term, f]
            z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def evidence(count: np.ndarray, toxic: np.ndarray, n: int, pos: float) -> np.ndarray:
    """Chi-square with Yates' correction of each term's presence against the label."""
    expect = count * pos / n
    spread = expect * (1 - pos / n) * (1 - count / n) + 1e-9
    return np.maximum(0, np.abs(toxic - expect) - 0.5) ** 2 / spread


def runs(starts: np.ndarray, total: int) -> list[tuple[int, int, int, int]]:
    """(first, end, start, stop): whole groups of about BLOCK members in all."""
    out, a, ends = [], 0, np.append(starts, total)
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK, "right")) - 1)
        out.append((a, b, int(ends[a]), int(ends[b])))
        a = b
    return out


def fit_machine(flat: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 11, rounds: int = 80, rate: float = 0.05, decay: float = 2e-4) -> Machine:
    """Adam on the mean logistic loss of the whole sample, each step followed by weight decay.

    The presences are held once by document and once by term, and sums run
    over blocks of either, so memory beside them does not follow their number.
    With one label only, or none, the score is that label's smoothed share.
    """
    n, pos = len(labels), float((labels == 1).sum())
    b = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    nothing = Machine(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)), b)
    if pos in (0.0, float(n)):
        return nothing
    seen = np.bincount(flat, minlength=1 << HASH_BITS)
    chosen = np.flatnonzero(seen >= LEAST_DOCS).astype(np.int32)
    m = len(chosen)
    if not m:
        return nothing
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(m)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    term = place[flat]
    doc, term = doc[term >= 0], term[term >= 0]
    chi = evidence(seen[chosen].astype(float), np.bincount(term, labels[doc] == 1, m), n, pos)
    pull = (EVIDENCE / np.maximum(chi, 1e-2)) ** 2
    held = np.concatenate((np.clip(pull, 1e-2, MOST_WEIGHT_DECAY)[:, None], np.repeat(np.clip(pull, 1e-2, MOST_FACTOR_DECAY)[:, None], FACTORS, 1)), 1)
    held = (decay * held).astype(np.float32)
    by_term = np.argsort(term, kind="stable")
    doc_of = doc[by_term]
    docs, first_of_doc = np.unique(doc, return_index=True)
    first_of_term = np.searchsorted(term[by_term], np.arange(m))
    doc_runs, term_runs = runs(first_of_doc, len(term)), runs(first_of_term, len(term))
    rng = np.random.default_rng(seed)
    theta = np.zeros((m, 1 + FACTORS), np.float32)  # weight, then factors
    theta[:, 1:] = rng.normal(0, 0.02, (m, FACTORS)) / np.sqrt(np.maximum(1, held[:, 1:] / decay))
    first, second, grad = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    first_b = second_b = 0.0
    y = (labels == 1).astype(np.float32)
    for t in range(1, rounds + 1):
        s, own = np.zeros((n, 1 + FACTORS), np.float32), np.zeros(n, np.float32)
        squares = (theta[:, 1:] ** 2).sum(1)
        for a, e, start, stop in doc_runs:
            at = first_of_doc[a:e] - start
            s[docs[a:e]] = np.add.reduceat(theta[term[start:stop]], at, axis=0)
            own[docs[a:e]] = np.add.reduceat(squares[term[start:stop]], at)
        z = b + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - own)
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / n
        s[:, 0] = error
        s[:, 1:] *= error[:, None]
        for a, e, start, stop in term_runs:
            grad[a:e] = np.add.reduceat(s[doc_of[start:stop]], first_of_term[a:e] - start, axis=0)
        grad[:, 1:] -= grad[:, :1] * theta[:, 1:]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        pace = rate / (np.sqrt(second / (1 - 0.999**t)) + 1e-7)
        theta = ((theta - pace * first / (1 - 0.9**t)) / (1 + pace * held)).astype(np.float32)
        slope = float(error.sum())
        first_b, second_b = 0.9 * first_b + 0.1 * slope, 0.999 * second_b + 0.001 * slope * slope
        b -= rate * (first_b / (1 - 0.9**t)) / ((second_b / (1 - 0.999**t)) ** 0.5 + 1e-8)
    return Machine(chosen, theta[:, 0].astype(float), theta[:, 1:].astype(float), b)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = SAMPLE_ROWS) -> Machine:
    def lists(column: pa.Array) -> pa.Array:
        flat, bounds = terms(column)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))

    got = gathered(labelled_sample(docs, labels, "toxic", keep, rows), lists, "array<int>")
    if not len(got):
        return Machine(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)), -2.0)
    lists = got.column("x").combine_chunks()
    bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    return fit_machine(lists.flatten().to_numpy(), bounds, got.column("label").to_numpy())


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``score`` and ``predicted`` to documents.

    Null text scores as empty text: the bias alone.  Labels train only outside
    the held-out fold.  Repeated rows score alike; an empty table gives no
    rows; columns of other names pass through, and those named score or
    predicted give way.
    """
    machine = fit(docs, labels, common.crc_mod("doc_id", 5) != 0)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(machine.score(column))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op8_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (common.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
