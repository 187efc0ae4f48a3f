"""SimHash groups by Golay keys against brute force."""
import re
from itertools import combinations

import numpy as np
import xxhash
from assayframe.llm import common, golay
from assayframe.llm.golay import LARGE, bucket_keys, codeword_keys, decoding_table, flipped_pairs, links, op12_golay_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    values = sorted(set(prints))
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            up[top(a)] = top(b)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[top(p)] = min(d, least.get(top(p), d))
    return sorted(((d, f"{p:016x}", least.get(top(p))) for (d, _), p in zip(rows, prints)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    assert got(op12_golay_simhash(spark, sf)) == brute(rows)


def test_odd_rows(spark, tmp_path):
    long = "words of a very long text " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo"), (8, "a b c"), (9, "Ünder É x y z"), (None, "a b c"), (None, "none other"), (8, "another text of this id"), (8, "a b c"), (20, long), (21, long + "end"), (22, "漢字 仮名 文字 列")]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(60)) + f" w{i}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as fp", "8 as bucket", "9 as component").write.parquet(str(tmp_path / "documents.parquet"))
    assert got(op12_golay_simhash(spark, str(tmp_path))) == brute(rows)


def test_empty_table(spark, sf, tmp_path):
    common.table(spark, sf, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert op12_golay_simhash(spark, str(tmp_path)).collect() == []


def test_code_is_perfect():
    table = decoding_table()
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    keys = codeword_keys(words, table)
    assert set((keys >= 0).sum(1).tolist()) == {1, 6}
    assert (np.bitwise_count(table[:, 0]) <= 3).all() and (golay.syndromes(words ^ table[golay.syndromes(words)][:, 0]) == 0).all()


def near_values(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = [base]
    for k in (1, 2, 3):
        flips = np.zeros(n, np.uint64)
        for i in range(n):
            flips[i] = sum(1 << int(b) for b in rng.choice(64, k, replace=False))
        out.append(base ^ flips)
    return np.unique(np.concatenate(out))


def test_pairs_within_two_bits_share_a_bucket():
    values = near_values(3, 400)
    at, bucket = bucket_keys(values, decoding_table())
    held = {}
    for i, b in zip(at.tolist(), bucket.tolist()):
        held.setdefault(i, set()).add(b)
    pairs = [(i, j) for i, j in combinations(range(len(values)), 2) if (int(values[i]) ^ int(values[j])).bit_count() <= 2]
    assert len(pairs) >= 800 and all(held[i] & held[j] for i, j in pairs)


def test_crowded_buckets_lose_nothing(spark):
    """More fingerprints than LARGE with one exact segment and one codeword."""
    rng = np.random.default_rng(5)
    crowd = np.unique((rng.integers(0, 1 << 12, 3 * LARGE, dtype=np.uint64) << np.uint64(43)) | np.uint64(12345))
    values = np.unique(np.concatenate((crowd, near_values(6, 50))))
    want = {tuple(sorted((int(a), int(b)))) for a, b in combinations(values.astype(np.int64).tolist(), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    prints = spark.createDataFrame([(int(v),) for v in values.astype(np.int64)], "fp long")
    assert prints.count() > LARGE
    for way in (links, flipped_pairs):
        assert {(r.a, r.b) for r in way(prints).collect()} == want
