"""SimHash near copies through fuzzy hashing with the binary Golay code.

A fingerprint has one bit for each bit position of 64-bit shingle hashes: 1
where more than half of a document's hashes have it set.  Equal fingerprints
are one node.

Two fingerprints that differ in at most two bits agree in one of their three
segments, and differ in at most one bit of another (pigeonhole).  The first is
compared as it is.  The second is decoded with the perfect (23, 12) Golay code:
every word lies within three bits of exactly one codeword, so a word one bit
away lies within four of it.  The codewords within four bits of a word, one or
six, are its keys; the nearest one is the key of a word of odd parity, and all
are keys of a word of even parity, so that words one bit apart share a key.
Pairs that share segment and key are joined and verified.

Fingerprints whose bucket is large meet by another way that needs no bucket:
two within two bits have a value in common among themselves and their
neighbours of one bit, and at most 65 fingerprints share such a value.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .textnp import LOWER, U, chunks, word_bounds

SHINGLE = 3
SEED = 42
MOST_BITS = 2
#: fixed values: the generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, and its length
GENERATOR, LENGTH, CHECK_BITS = 0b110001110101, 23, 11
#: segments of a fingerprint as (lowest bit, bits); shorter ones are words of the code with zeros on top
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: fingerprints of one bucket that are compared with each other
LARGE = 256
HASH_BLOCK = 1 << 16


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of words by the generator polynomial: 0 for codewords."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECK_BITS)), rest)
    return rest


def decoding_table() -> np.ndarray:
    """For each remainder the differences of up to four bits that explain it, the nearest first, padded with -1."""
    errors = np.array([sum(1 << b for b in bits) for size in range(5) for bits in combinations(range(LENGTH), size)])
    table = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    used = np.zeros(1 << CHECK_BITS, np.int64)
    for error, rest in zip(errors.tolist(), syndromes(errors).tolist()):
        table[rest, used[rest]] = error
        used[rest] += 1
    return table


def codeword_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each word, the nearest first, padded with -1; (words, 6)."""
    errors = table[syndromes(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK_BITS, -1)


def bucket_keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, bucket) of all buckets: an exact segment and a codeword near another one."""
    parts = [((prints >> U(low)) & U((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    keys = [codeword_keys(p, table) for p in parts]
    for p, k in zip(parts, keys):
        odd = np.bitwise_count(p) & 1 == 1
        k[odd, 1:] = -1
    at, buckets = [], []
    for kind, (x, y) in enumerate(permutations(range(len(SEGMENTS)), 2)):
        row, column = np.nonzero(keys[y] >= 0)
        at.append(row)
        buckets.append((np.int64(kind) << 40) | (parts[x][row] << 12) | keys[y][row, column])
    return np.concatenate(at), np.concatenate(buckets)


def normal_words(raw: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one space between: (bytes, starts, ends, words per document)."""
    starts, ends, count = word_bounds(raw, offs)
    lengths = ends - starts
    new_starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    at = np.zeros(len(out) + 1, np.int64)
    at[new_starts] = 1
    word = np.cumsum(at[:-1]) - 1
    inside = np.arange(len(out)) - new_starts[word] < lengths[word]
    out[inside] = LOWER[raw[(np.arange(len(out)) - new_starts[word] + starts[word])[inside]]]
    return out.tobytes(), new_starts, new_starts + lengths, count


def fingerprints(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each document of a chunk."""
    text, starts, ends, count = normal_words(raw, offs)
    first = np.cumsum(count) - count
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(len(count), U)
    digest = xxhash.xxh64_intdigest
    for d in np.flatnonzero(n).tolist():
        a, k = int(first[d]), int(n[d])
        step = size if count[d] >= size else int(count[d])
        s, e = starts[a : a + k].tolist(), ends[a + step - 1 : a + step - 1 + k].tolist()
        total = np.zeros(64, np.int64)
        for b in range(0, k, HASH_BLOCK):
            h = np.fromiter((digest(text[x:y], SEED) for x, y in zip(s[b : b + HASH_BLOCK], e[b : b + HASH_BLOCK])), U, min(HASH_BLOCK, k - b))
            total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[d] = np.packbits(2 * total > k, bitorder="little").view(U)[0]
    return out


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints(raw, offs) for _, _, raw, offs in chunks(batch.column(1))]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long")


def within(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MOST_BITS


def bucket_rows(prints: DataFrame) -> DataFrame:
    """(bucket, fp) rows of the distinct fingerprints ``fp``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table()
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, bucket = bucket_keys(fp.view(U), table)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fp[at])], names=["bucket", "fp"])

    return prints.select("fp").mapInArrow(deal, "bucket long, fp long")


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in at most two bits."""
    rows = common.staged(bucket_rows(prints), "golay-buckets")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    sizes = common.staged(sizes, "golay-sizes")
    met = rows.join(sizes.where(F.col("c") <= LARGE).select("bucket"), "bucket")
    met = met.groupBy("bucket").agg(F.collect_list("fp").alias("fps"))  # of LARGE at most
    pairs = met.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= MOST_BITS))).alias("b"))
    crowded = sizes.where(F.col("c") > LARGE)
    if not crowded.isEmpty():
        pairs = pairs.union(flipped_pairs(rows.join(crowded.select("bucket"), "bucket").select("fp").distinct()))
    return pairs.distinct()


def flipped_pairs(prints: DataFrame) -> DataFrame:
    """The same pairs by values that a fingerprint has or reaches with one bit; at most 65 share one."""
    ones = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = prints.select("fp", F.explode(ones).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    met = near.groupBy("value").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return met.select("fps", F.explode("fps").alias("a")).select("a", F.explode(F.filter("fps", lambda b: b > F.col("a"))).alias("b")).distinct()


def fingerprint_groups(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fp, component_id.

    Null and empty texts and texts of white space have fingerprint zero, which
    links like any other.  Texts of fewer than three words are one shingle.
    Repeated shingles count as often as they stand.  Repeated ids keep their
    rows, each with the group of its own text.  Null ids are the smallest id
    of no group; a group without another id has a null component_id.  Texts
    of any length count whole.  An empty table gives no rows; extra columns
    are ignored.
    """
    rows = common.staged(fingerprint_rows(docs), "golay-rows")
    nodes = common.staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "golay-nodes")
    found = common.staged(links(nodes), "golay-links")
    comps = connected_components(found).withColumnRenamed("node", "fp")
    named = nodes.join(comps, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = common.staged(named, "golay-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
