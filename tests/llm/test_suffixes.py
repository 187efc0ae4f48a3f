"""Removal of repeated byte strings against a direct count of 50-byte strings."""
import hashlib
import random

import numpy as np
import pytest

from assayframe.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, kind int, blob string"


def brute(rows):
    least = {}
    for i, text in rows:
        if i is None:
            continue
        data = (text or "").encode()
        for k in range(len(data) - 49):
            g = data[k : k + 50]
            least[g] = min(i, least.get(g, i))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if i is not None:
            for k in range(len(data) - 49):
                if least[data[k : k + 50]] < i:
                    gone[k : k + 50] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(data) else 0
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in suffixes.deduplicate(df).collect()]


def key(r):
    return tuple((x is not None, x) for x in r)


def made_rows(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = [prose(30) for _ in range(3)]
    rows = []
    for i in range(60):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, 40)
            text += " " + p[a : a + rng.randint(45, 120)] + " " + prose(rng.randint(0, 8))
        rows.append((i * 3, text))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (502, "a" * 400), (503, "a" * 130 + "b"), (504, ""), (505, None), (500, rows[4][1]), (500, passage[0]), (None, passage[1])]
    rows += [(600 + i, "xyz" * 30 + str(i)) for i in range(20)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made_rows(seed)
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_whole_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in suffixes.op9_suffix_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_empty(spark):
    assert run(spark, []) == []


def test_mergesort_orders_suffixes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    where = rng.integers(0, 2900, 400)
    segment = np.sort(rng.integers(0, 9, 400))
    sums = suffixes.prefix_sums(data)
    whole = (sums[where + 50] - sums[where]) * suffixes.powers(suffixes.INVERSE, len(data))[where]
    order, equal = suffixes.sort_suffixes(data, sums, where, whole, np.arange(400), segment)
    text = [(s, data[w : w + 50].tobytes()) for s, w in zip(segment, where[order])]
    assert text == sorted(text)
    assert equal.tolist() == [k > 0 and text[k] == text[k - 1] for k in range(400)]


def test_passages_that_recur_over_chunks_of_a_task(spark):
    """Every document is a chunk of its own and all lie in one task; ids fall and rise."""
    rng = np.random.default_rng(8)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    passage = ["A" + "".join(map(chr, letters[rng.integers(0, 26, 298)])) + "Z" for _ in range(2)]
    ids = [9, 8, 2, 7, 1, 5, 6, 3]
    rows = []
    for k, i in enumerate(ids):
        body = letters[rng.integers(0, 26, 2_200_000)].tobytes().decode()
        text = body[:1000] + f"{i}" + passage[0] + f"{i}-" + body[1000:]
        if k > 2:
            text += f"{i}" + passage[1] + f"{i}="
        rows.append((i, text, "en", 1, "x"))
    got = {r.doc_id: r for r in suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).coalesce(1), keep_text=True).collect()}
    for k, i in enumerate(ids):
        want = rows[k][1]
        if i != 1:
            want = want.replace(passage[0], "")
        if k > 2 and i != 1:
            want = want.replace(passage[1], "")
        assert bytes(got[i].kept).decode() == want and got[i].n_spans == (i != 1) + (k > 2 and i != 1)


def test_what_recurs_is_told_once_and_found_again():
    r = suffixes.Recurring(np.int64)
    keys = np.array([5, 1 << 60, 7 << 50], np.uint64)
    assert r.find(keys).tolist() == [-1, -1, -1]
    assert not r.due(keys).any() and not r.due(keys[:2]).any() and r.due(keys).tolist() == [True, True, False]
    r.keep(keys[:2], np.array([10, 20]))
    r.keep(np.array([1 << 61], np.uint64), np.array([30]))
    at = r.find(np.array([1 << 60, 9, 1 << 61], np.uint64))
    assert at[1] == -1 and r.values[at[[0, 2]]].tolist() == [20, 30]


def test_overlong_text_is_refused():
    with pytest.raises(ValueError):
        suffixes.anchors(np.lib.stride_tricks.as_strided(np.zeros(1, np.uint8), (1 << 28,), (0,)), np.array([0, 1 << 28]), None)
