"""The curve, the shards' law and their pruning."""
import zlib

import numpy as np

from assayframe.llm import hilbert


def test_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        d = hilbert.hilbert_index(grid, bits)
        assert sorted(d) == list(range(len(grid)))
        path = grid[np.argsort(d)].astype(int)
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_contract(spark):
    d = "/root/testdata/sf0.01"
    out = hilbert.op3_hilbert_sharding(spark, d).toPandas()
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(out["doc_id"]) == sorted(docs.index)
    for r in out.itertuples():
        data = docs.loc[r.doc_id, "text"].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "rows")
    n = out.groupby("shard").size()
    assert list(n.index) == list(range(40)) and n.max() - n.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    order = out.sort_values(["shard", "slot"])[["hilbert", "doc_id"]].apply(tuple, axis=1).tolist()
    assert order == sorted(order)


def test_pruning(spark):
    """A shard of Hilbert runs spans fewer sources, languages and sizes than a shard of doc_id runs."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "lang").toPandas()
    out = hilbert.op3_hilbert_sharding(spark, d).toPandas().merge(docs, on="doc_id")
    out["plain"] = out["doc_id"].rank(method="first").astype(int) * 40 // (len(out) + 1)
    out["scale"] = np.floor(np.log2(out["size"]))
    for name, share in (("source", 0.5), ("lang", 0.7), ("scale", 0.7)):
        mine, plain = (out.groupby(by)[name].nunique().mean() for by in ("shard", "plain"))
        assert mine < share * plain, (name, mine, plain)


def plain_hilbert(cell, bits):
    """The curve's index of one cell, bit by bit (Skilling's transform on single numbers)."""
    x, q = list(cell), 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def test_equals_plain_loops(spark):
    """Cells, order and cuts of the whole query by loops over rows."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    count = {c: docs[c].dropna().value_counts() for c in ("lang", "source")}
    order = {c: sorted(n.index, key=lambda v: (-n[v], v)) for c, n in count.items()}

    def place(name, value):
        if value is None:
            return 0
        at = order[name].index(value)
        return 1 + at * 111 // min(111, len(order[name])) if at < 111 else zlib.crc32(value.encode()) % 16 + 112

    rows = []
    for r in docs.itertuples():
        size = len(r.text.encode()) + 16
        cell = (place("lang", r.lang), place("source", r.source), min(127, int(np.floor(4 * np.log2(size + 1)))))
        rows.append((plain_hilbert(cell, 7), r.doc_id))
    want, at, ranked = {}, 0, sorted(rows)
    for shard in range(40):
        for slot in range(len(rows) // 40 + (shard < len(rows) % 40)):
            want[ranked[at][1]] = (shard, slot, ranked[at][0])
            at += 1
    got = hilbert.op3_hilbert_sharding(spark, d).collect()
    assert {r.doc_id: (r.shard, r.slot, r.hilbert) for r in got} == want


def test_rare_categories_share_the_rest(spark):
    rows = [(i, "t", "en", f"s{i % 300 if i < 900 else 0}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cells = df.select("source", hilbert.category_cell(df, "source", 7).alias("c")).distinct().collect()
    by = {r.source: r.c for r in cells}
    assert by["s0"] == 1 and len({c for c in by.values() if c <= 111}) == 111 and all(112 <= c <= 127 for c in by.values() if c > 111)


def test_edges(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "é", "en", "s"), (2, "x" * 100_000, "en", "s")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, hilbert int")
    out = hilbert.shard_documents(docs.drop("hilbert"), 3).toPandas()
    assert sorted(out["size"]) == [16, 16, 18, 100_016] and sorted(out.groupby("shard").size()) == [1, 1, 2]
    assert len(hilbert.shard_documents(docs, 40).collect()) == 4
    assert hilbert.shard_documents(docs.limit(0)).collect() == []
