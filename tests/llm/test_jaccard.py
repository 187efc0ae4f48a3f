"""Groups of similar shingle sets against all pairs."""
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayframe.llm import components, jaccard, places, textnp


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """{(doc_id, text): (n, component)} by all pairs."""
    sets = [shingles(t) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 7, "x", "y") for d, t in rows], "doc_id long, text string, n int, fp string, key string").repartition(4)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similarity_groups(df).collect()), key=str)


def made(seed, variants=40):
    """Groups of near copies around the threshold, shared passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    passage = prose(40)
    rows, d = [], 100
    for _ in range(4):
        base = prose(rng.randint(60, 140))
        for _ in range(variants):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
                w[rng.randrange(len(w))] = word()
            rows.append((d, " ".join(w)))
            d += rng.randint(1, 3)
    for _ in range(30):
        w = prose(rng.randint(3, 50))
        at = rng.randint(0, len(w))
        rows.append((d, " ".join(w[:at] + passage + w[at:])))
        d += 1
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  Two"), (6, "one two three"), (7, rows[0][1].upper()), (100, rows[0][1]), (8, "a b c d e"), (9, "A b\nc d E"), (10, "q " * 300)]
    return rows


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert run(spark, rows) == brute(rows)


def test_hot_lists_in_blocks(spark, monkeypatch):
    """Postings of frequent tokens in several parts, lists met block by block: the same groups."""
    monkeypatch.setattr(jaccard, "HOT_POSTINGS", 3)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 4)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", 0)
    rows = made(3)
    assert run(spark, rows) == brute(rows)


def test_null_id_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (5, "x y z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def stage(spark, sf, rows, columns="doc_id long, text string, lang string"):
    docs = spark.createDataFrame(rows, columns)
    kept = jaccard.near_duplicate_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    return sorted(map(tuple, kept.collect()), key=str)


def test_stage_judges_rows_not_ids(spark, sf):
    a, b = "a b c d e f", "other words are here now"
    rows = [(5, a, "en"), (5, a, "en"), (5, a.upper(), "de"), (6, "A b c d e f", "de"), (7, b, "en"), (8, None, "en"), (8, None, "en"), (9, " ", "fr")]
    assert stage(spark, sf, rows) == sorted([(5, a.upper(), "de"), (7, b, "en"), (8, None, "en"), (8, None, "en"), (9, " ", "fr")], key=str)
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "z"), (None, a, "n"), (None, "only here without an id", "n"), (None, "only here without an id", "m")]
    assert stage(spark, sf, rows) == sorted([(1, a, "x"), (5, b, "z"), (None, "only here without an id", "m")], key=str)
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b, "z")]  # one id, two groups
    assert stage(spark, sf, rows) == sorted(rows[:2], key=str)
    assert stage(spark, sf, []) == []
    clash = [(1, a, 1, {"k": "v"}), (2, a, 2, {"k": "w"}), (1, a, 3, {"k": "u"})]
    assert stage(spark, sf, clash, "doc_id long, text string, fp int, m map<string,string>") == [(1, a, 1, {"k": "v"})]


def test_further_orders_are_met_before_sets():
    rng = np.random.default_rng(3)
    pairs = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        y = np.concatenate((x[:54], rng.integers(0, 1 << 63, 6).astype(np.uint64)))
        pairs += [(x, y, True), (x, np.concatenate((x[:3], rng.integers(0, 1 << 63, 57).astype(np.uint64))), False)]
    none = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)

    def heads(x):
        p = int(jaccard.prefix_sizes(np.array([len(x)]))[0])
        return b"".join(np.sort(jaccard.order_keys(x, none, k))[:p].astype(np.uint32).tobytes() for k in (1, 2))

    passed = [jaccard.share_prefixes(heads(x), heads(y)) for x, y, _ in pairs]
    assert all(p for p, (_, _, near) in zip(passed, pairs) if near)
    assert sum(p for p, (_, _, near) in zip(passed, pairs) if not near) < 30  # of 40 unlike pairs, many go here


def test_filters_lose_nothing():
    """Prefix, position and histogram filters pass every pair at the threshold."""
    rng = np.random.default_rng(5)
    classes = rng.integers(0, 9, 1 << jaccard.SKETCH_BITS).astype(np.uint8)
    for n in (1, 2, 5, 9, 10, 40, 333):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            drop = n // 9
            y = np.concatenate((x[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1)).astype(np.uint64)))
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            for k in range(len(jaccard.ORDERS)):
                a, b = (np.sort(jaccard.order_keys(s, classes, k)) for s in (x, y))
                p, q = (int(jaccard.prefix_sizes(np.array([len(s)]))[0]) for s in (x, y))
                common = np.intersect1d(a[:p], b[:q])
                assert len(common)
                i, j = np.searchsorted(a, common[0]), np.searchsorted(b, common[0])
                assert jaccard.may_pair(np.array([len(x)]), np.array([i]), np.array([len(y)]), np.array([j]))[0]
            hx, hy = (np.frombuffer(jaccard.histograms(s, np.array([0, len(s)]))[0], np.uint8) for s in (x, y))
            assert jaccard.most_shared(hx, hy) >= both


def test_shingle_hashes_follow_definition():
    texts = ["a b c d e f g", "A  b c\td e", "x", "", "é ü ß a b c", "a b c d e f g a b c d e"]
    raw, offs = textnp.text_buffer(pa.array(texts))
    flat, bounds = textnp.shingle_sets(raw, offs)
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == got[200] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stage_with_the_code_s_own_names(spark, sf):
    names = ("row", "row_number", "row_run", "listed_rows", "tie", "fp", "n", "component", "first", "l", "r")
    docs = spark.createDataFrame([(i, "a b c d e f g" if i < 5 else f"text {i} of its own here") for i in range(9)], "doc_id long, text string").withColumns({c: F.lit(7) for c in names})
    out = jaccard.near_duplicate_stage(spark, docs, sf)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {0, 5, 6, 7, 8}
    assert out.where(" or ".join(f"{c} != 7" for c in names)).isEmpty()


def test_texts_stay_in_place(spark):
    """The rows to drop come to the texts by run: the side that holds texts has no exchange."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        at_hand = places.placed(docs, "test")
        rows = at_hand.table.where("doc_id % 3 = 0").select(F.col(at_hand.row).alias("row"))
        some, rest = at_hand.only(rows), at_hand.without(rows)
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in some.collect()} == set(range(0, 300, 3)) and {r.doc_id for r in rest.collect()} == set(range(300)) - set(range(0, 300, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = plan.split("SortMergeJoin")[1]
    assert "Exchange" not in joined.split("Scan parquet")[0] and "Bucketed: true" in joined


def test_short_lists_give_pairs_and_no_postings(spark):
    key, n = np.array([7, 7, 9, 9, 9, 11], np.uint64), np.full(6, 100)
    fp, pos, hot = np.array([5, 3, 3, 4, 5, 6]), np.array([0, 1, 2, 0, 60, 0]), np.zeros(6, bool)
    blobs = [jaccard.pack(key[i], fp[i], n[i], pos[i], hot[i]) for i in (slice(0, 3), slice(3, 6))]
    packed = spark.createDataFrame([(0, b) for b in blobs], "part int, blob binary")
    rows = jaccard.runs(packed, 1).collect()
    assert sorted((r.a, r.b, r.c) for r in rows) == [(3, 4, 1), (3, 5, 1)]
    k = jaccard.SHORT_LIST + 1
    blob = jaccard.pack(np.full(k, 7, np.uint64), np.arange(k), np.full(k, 100_000), np.zeros(k, np.int32), np.zeros(k, bool))
    rows = jaccard.runs(spark.createDataFrame([(0, blob)], "part int, blob binary"), 1).collect()
    assert sorted(r.fp for r in rows if r.key is not None) == list(range(k))
    assert {r.n for r in rows if r.key is not None} == {100_000}


def test_postings_take_18_bytes():
    k = 1000
    rng = np.random.default_rng(2)
    key, fp = rng.integers(0, 1 << 48, k).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, k)
    n, pos, hot = rng.integers(1, 60_000, k), rng.integers(0, 9_000, k), rng.integers(0, 2, k).astype(bool)
    assert len(jaccard.pack(key, fp, n, pos, hot & False)) == 18 * k + 12
    for sizes in (n, n + 70_000):
        for marks in (hot, hot & False):
            got = jaccard.unpack([jaccard.pack(key, fp, sizes, pos, marks)])
            assert all((x == y).all() for x, y in zip(got, (key, fp, sizes, pos, marks), strict=True))


def test_components_of_one_partition_take_one_pass(spark, monkeypatch):
    names, staged = [], components.common.staged
    monkeypatch.setattr(components.common, "staged", lambda df, name: names.append(name) or staged(df, name))
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 0 for k in range(100, 140)}}
    assert names == ["edges"]


def test_components_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "FOREST_EDGES", 3)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(80)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    top = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(500):
        for x, y in edges:
            if x != y:
                top[x] = top[y] = min(top[x], top[y])
    assert got == top
