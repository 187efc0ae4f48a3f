"""Quality scores learned from preference pairs (Bradley-Terry).

A pair is a labelled good document preferred to a labelled bad one; the
probability that i beats j is sigmoid(w . (x_i - x_j)), so w is fitted by
logistic loss on feature differences.  The raw score w . x is cut at a
quantile of the labelled sample's scores, and the cut maps to 0.7.  The level
of that quantile is a parameter; unless it is given, it is the one of LEVELS
at which the two labels are best told apart.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textnp import SMALL_BYTES, chunks, release_memory, span_hashes, word_bounds

CUT = 0.7
SAMPLE_ROWS = 20_000
#: pairs of each sampled document of the rarer label, so at most 4 pairs for each row of the sample
PAIRS_PER_DOC = 8

LEVELS = np.arange(1, 1000) / 1000

# Byte classes: 0 a-z, 1 A-Z, 2 digits, 3 space, 4 other white space, 5 beyond ASCII, 6 control
# characters; then ASCII punctuation by its use: 7 ends sentences, 8 joins or parts words,
# 9 quotes and brackets, 10 symbols.
CLASS = np.full(256, 6, np.uint8)
CLASS[97:123] = 0
CLASS[65:91] = 1
CLASS[48:58] = 2
CLASS[32] = 3
CLASS[9:14] = 4
CLASS[128:] = 5
for number, chars in ((7, b".!?"), (8, b",;:-'/_"), (9, b"\"()[]{}<>`"), (10, b"#$%&*+=@\\^|~")):
    CLASS[list(chars)] = number
N_CLASS = 11
N_PAIRS = N_CLASS * N_CLASS
N_FEATURES = N_PAIRS + 4


def features(column: pa.Array) -> np.ndarray:
    """Shape of each whole text: roots of byte-class pair shares, repetition, log length.

    Repetition is the share of words equal to the word before, the share of
    words seen before in the text, and the share of words equal to the second
    before.
    """
    out = np.zeros((len(column), N_FEATURES))
    for a, b, raw, offs in chunks(column, SMALL_BYTES):
        cls = CLASS[raw]
        code = cls[:-1] * np.uint8(N_CLASS) + cls[1:]
        starts, ends, n_words = word_bounds(raw, offs)
        h = span_hashes(raw, starts, ends)
        doc = np.repeat(np.arange(b - a), n_words)
        many = np.maximum(n_words, 1)
        for back, f in ((1, N_PAIRS), (2, N_PAIRS + 2)):
            same = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
            out[a:b, f] = np.bincount(doc[back:][same], minlength=b - a) / many
        word = np.concatenate(([0], np.cumsum(n_words)))
        for d, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
            if e - s > 1:
                out[a + d, :N_PAIRS] = np.sqrt(np.bincount(code[s : e - 1], minlength=N_PAIRS) / (e - s - 1))
            mine = h[word[d] : word[d + 1]]
            mine.sort()
            out[a + d, N_PAIRS + 1] = (mine[1:] == mine[:-1]).sum() / many[d]
        out[a:b, N_PAIRS + 3] = np.log1p(np.diff(offs)) / 10
    return out


@dataclass
class Model:
    """Weights on raw features and the map of raw scores to 0..1; ``cut`` is the sample's quantile at ``level``."""

    weights: np.ndarray
    cut: float
    slope: float
    level: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (x @ self.weights - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def preference_pairs(labels: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other) rows: each document of the rarer label meets several of the other."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    each = max(PAIRS_PER_DOC, 2 * len(many) // max(1, len(few)))
    rng = np.random.default_rng(seed)
    left = np.repeat(few, each)
    right = many[rng.integers(0, len(many), len(left))]
    return (right, left) if few is bad else (left, right)


def fit_pairs(x: np.ndarray, labels: np.ndarray, seed: int = 7, ridge: float = 1e-3, rounds: int = 25, level: float | None = None) -> Model:
    """Newton steps on the pairwise logistic loss.

    Without both labels there are no pairs: every document then scores 0.7.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return Model(np.zeros(x.shape[1]), 0.0, 1.0)
    scale = x.std(0)
    scale[scale < 1e-9] = np.inf
    win, lose = preference_pairs(labels, seed)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for a in range(0, len(win), 4096):  # pairs in blocks: memory does not follow their number
            diff = (x[win[a : a + 4096]] - x[lose[a : a + 4096]]) / scale
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -35, 35)))
            grad = grad + diff.T @ (p - 1) / len(win)
            hess = hess + (diff * (p * (1 - p))[:, None]).T @ diff / len(win)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = w / scale
    raw = x @ w
    level = best_level(raw, labels) if level is None else level
    cut = float(np.quantile(raw, level))
    return Model(w, cut, slope_of(raw - cut, labels), level)


def best_level(raw: np.ndarray, labels: np.ndarray) -> float:
    """The level of LEVELS whose quantile has the least mean error rate of the two labels; of equals the middle one."""
    cuts = np.quantile(raw, LEVELS)
    bad, good = np.sort(raw[labels == 0]), np.sort(raw[labels == 1])
    error = (len(bad) - np.searchsorted(bad, cuts)) / len(bad) + np.searchsorted(good, cuts) / len(good)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(LEVELS[best[len(best) // 2]])


def slope_of(z: np.ndarray, labels: np.ndarray) -> float:
    """Slope of sigmoid(a z + logit 0.7) against the labels, by bisection."""
    base = np.log(CUT / (1 - CUT))
    lo, hi = 1e-3, 50.0
    for _ in range(50):
        a = (lo * hi) ** 0.5
        p = 1 / (1 + np.exp(-np.clip(a * z + base, -35, 35)))
        lo, hi = (a, hi) if ((p - labels) * z).mean() < 0 else (lo, a)
    return float(lo)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int) -> DataFrame:
    """(doc_id, label, text) of the documents of at most ``rows`` labelled ids, taken in hash order.

    The sampled ids, at most ``rows`` of them, are the broadcast side.  An id
    that repeats in ``docs`` comes once for each of its rows.
    """
    picked = (
        labels.where(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", F.col("__label").alias("label"), "text")


def gathered(sample: DataFrame, features, kind: str) -> pa.Table:
    """(label, x) of one row an id, in an order of their own: ``features`` of the text with the least hash.

    The texts stay where they are; of each id one row of features goes on.
    """

    def gather(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), features(b.column(2))], names=["doc_id", "label", "h", "x"])

    rows = sample.withColumn("h", F.xxhash64("text")).mapInArrow(gather, f"doc_id long, label int, h long, x {kind}")
    once = rows.groupBy("doc_id").agg(F.min(F.struct("h", "label", "x")).alias("r"))
    got = once.select("doc_id", "r.label", "r.x").toArrow()
    return got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable")))


def fit(docs: DataFrame, labels: DataFrame, keep: Column, rows: int = SAMPLE_ROWS) -> Model:
    def shape(column: pa.Array) -> pa.Array:
        x = features(column).astype(np.float32)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))

    got = gathered(labelled_sample(docs, labels, "quality", keep, rows), shape, "array<float>")
    if not len(got):
        return Model(np.zeros(N_FEATURES), 0.0, 1.0)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES).astype(float)
    return fit_pairs(x, got.column("label").to_numpy())


def score_column(model: Model, text: str = "text") -> Column:
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = pa.array(model.score(features(column)))
        release_memory()  # the worker may wait through later stages
        return out

    return score(F.col(text))


def train_fold() -> Column:
    return common.crc_mod("doc_id", 4) != 2


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``score`` and ``predicted`` to documents.

    Null text scores as empty text.  Labels train only outside the held-out
    fold.  Repeated rows score alike; an empty table gives no rows; columns
    of other names pass through, and those named score or predicted give way.
    """
    model = fit(docs, labels, train_fold())
    scored = docs.withColumn("score", score_column(model))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op5_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier predicts to be of label 1.

    Null text is judged as empty text; texts of any length count whole.
    Repeated rows are judged alike; without labels of both kinds every row
    stays; columns of any name pass through; an empty table gives no rows.
    """
    model = fit(docs, common.table(spark, sf_dir, "labels"), train_fold())
    return docs.where(score_column(model) >= CUT)
