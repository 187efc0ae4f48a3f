"""Merkle manifest against a plain one in Python."""
import hashlib
import zlib
from itertools import groupby

import pytest
from assayframe.llm import common, merkle
from assayframe.llm.merkle import FIELDS, manifest, op13_merkle_manifest, proven
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """(top, proof of each node as (before, after) by level)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_no, node in enumerate(at):
            a = node // fanout * fanout
            run = nodes[a : a + fanout]
            ways[leaf_no].append(("".join(run[: node - a]), "".join(run[node - a + 1 :])))
        nodes = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        at = [node // fanout for node in at]
    return nodes[0], ways


def brute(rows, fanout=16):
    name = lambda r: b"" if r[1] is None else b"s" + r[1].encode()
    rows = sorted(rows, key=lambda r: (name(r), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [(k, list(g)) for k, g in groupby(rows, name)]
    if not groups:
        return []
    built = [tree([leaf(r) for r in g], fanout) for _, g in groups]
    root, over = tree([top for top, _ in built], fanout)
    out = []
    for (_, g), (top, ways), above in zip(groups, built, over):
        for r, way in zip(g, ways):
            way = [*way, *above]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in way:
                node = h(a, node, b)
            out.append((r[0], leaf(r), top, root, h(*(a + b for a, b in way)), node, node == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_whole_table(spark, sf):
    rows = [tuple(r[c] for c in FIELDS) for r in common.table(spark, sf, "documents").collect()]
    want = brute(rows)
    assert got(op13_merkle_manifest(spark, sf)) == want
    assert {v for *_, v in want} == {True, False}


def test_shapes(spark, tmp_path):
    """Groups of 1, 16, 17 and 300 rows; null and empty values, null ids, repeated rows and ids."""
    rows = [(i, "one", "en", 3, f"Text {i}") for i in range(300)]
    rows += [(1000 + i, "Two", "de", i, "UP") for i in range(16)] + [(2000 + i, "é", None, None, "Ünder") for i in range(17)]
    rows += [(5000, "lone", "fr", 1, "A"), (5001, "", "", 0, ""), (5002, None, None, None, None), (None, None, "en", 1, "No id"), (None, None, "en", 1, "No id")]
    rows += [(7, "one", "en", 3, "Text 7"), (7, "one", "en", 3, "another"), (6000, "one", "en", 10**6, "Long " * 200_000)]
    rows += [(9000 + i, f"source {i:02d}", "en", i, "Many Sources") for i in range(40)]
    assert got(op13_merkle_manifest(spark, written(spark, rows, tmp_path))) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, tmp_path, n):
    rows = [(i, f"s{i}", "en", i, "Abc") for i in range(n)]
    assert got(op13_merkle_manifest(spark, written(spark, rows, tmp_path))) == brute(rows)


def test_extra_columns_and_other_fanout(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"T{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ("tree", "pos", "n", "digest", "run", "row", "id", "path", "root", "part")})
    found = proven(docs, fanout=3)
    want = brute(rows, 3)
    assert sorted((r.id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in found.collect()) == sorted(w[:5] for w in want)
    assert found.where("not verified").isEmpty()


def test_manifest_holds_every_node_once(spark):
    rows = [(i, "ab"[i % 2], "en", i, f"T{i}") for i in range(50)]
    nodes = manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(nodes) == 50 + 4 + 2 + 2 + 1
    root = max(nodes, key=lambda r: r.level)
    assert root.digest == brute(rows)[0][3] and root.tree is None


def test_windows_are_runs(spark):
    """No window is partitioned by a whole group."""
    docs = spark.createDataFrame([(i, "a", "en", i, "t") for i in range(40)], SCHEMA)
    leaves = merkle.placed_leaves(merkle.staged_leaves(docs, FIELDS, "doc_id", "source"))
    plan = merkle.with_siblings(merkle.runs_of(leaves))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tree" in plan and ", run#" in plan.split("hashpartitioning(tree")[1].split(")")[0]
