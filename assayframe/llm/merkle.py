"""Merkle manifest of a table: one digest a row, one a group, one for all.

Rows are leaves, in order within their group.  While a group has several
nodes, every ``FANOUT`` consecutive ones become one; the groups' tops are the
leaves of a last tree.  A level is one pass of lag and lead columns of fixed
offsets, masked by a node's slot in its run and by the run's length: they give
each node its siblings, and each run's first node the digest of the parent.

Windows are partitioned by run, so that none holds more than ``FANOUT`` rows
whatever the size of a group.  Places within a group come from a range
partitioning and the counts of its parts.  Texts are read once and hashed where
they lie; what moves is a digest a row, twice.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """A value with its length in front, so that no two rows have one writing; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return digest(*map(framed, values))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the gapless place within ``tree``, and ``n``, the tree's leaves.

    ``order`` ends in a unique column, so a third of all rows with one key is
    cut like any other.  The counts that are joined back are one row a part
    and tree.
    """
    spark = leaves.sparkSession
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]
    cut = leaves.repartitionByRange(common.parts(spark), *keys).sortWithinPartitions(*keys)
    cut = common.staged(cut.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle-order")
    counts = cut.groupBy("part", "tree").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    by_tree = Window.partitionBy("tree")  # one row a part
    upto = F.sum("c").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    counts = counts.select("part", "tree", (upto - F.col("first")).alias("shift"), F.sum("c").over(by_tree).alias("n"))
    return cut.join(counts, ["part", "tree"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes (tree, run, pos, n, digest) with the digests before and after them in their run, as texts."""
    run = Window.partitionBy("tree", "run").orderBy("pos")
    slot = F.col("pos") % fanout
    length = F.least(F.lit(fanout).cast("long"), F.col("n") - (F.col("pos") - slot))
    nothing = F.lit("")
    before = [F.when(slot >= k, F.lag("digest", k).over(run)).otherwise(nothing) for k in range(fanout - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("digest", k).over(run)).otherwise(nothing) for k in range(1, fanout)]
    return nodes.withColumns({"before": F.concat(*before), "after": F.concat(*after)})


def runs_of(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    return nodes.withColumn("run", F.floor(F.col("pos") / fanout))


@dataclass
class Forest:
    """``levels`` from the leaves up: (tree, pos, n, digest); ``tops``: (tree, digest) of each tree."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, fanout: int = FANOUT) -> Forest:
    """All levels of every tree; a tree of one node has that one as its top."""
    levels, tops = [leaves.select("tree", "pos", "n", "digest")], []
    while True:
        nodes = levels[-1]
        tops.append(nodes.where("n = 1").select("tree", "digest"))
        most = nodes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        first = with_siblings(runs_of(nodes.where("n > 1"), fanout), fanout).where(F.col("pos") % fanout == 0)
        above = first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.col("digest"), F.col("after")).alias("digest"))
        levels.append(common.staged(above, "merkle-level"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Forest(levels, out)


def ended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, run, path, ...) of trees whose top is on this level: what lies above the tree."""
    tops = nodes.where("n = 1").select("tree")
    return above.join(tops, "tree").withColumn("run", F.lit(0).cast("long"))


def paths(forest: Forest, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, run, path, carried columns): for each run of leaves, the siblings met from its parent to the root.

    ``above`` has (tree, path, carried columns): the way from a tree's top on.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    over = None
    for nodes in reversed(forest.levels[1:]):
        here = ended(nodes, above)
        here = here if over is None else here.unionByName(over)
        met = with_siblings(runs_of(nodes, fanout).join(here, ["tree", "run"]), fanout)
        step = F.array(F.struct("before", "after"))
        way = F.when(F.col("n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
        over = common.staged(met.select("tree", F.col("pos").alias("run"), way.alias("path"), *carried), "merkle-paths")
    here = ended(forest.levels[0], above)
    return here if over is None else here.unionByName(over)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT) -> DataFrame:
    """Every node of the trees: (group, level, pos, digest); level 0 are leaves, the root has no group and the greatest level.

    The nodes between the groups' tops and the root have a null ``tree`` name;
    ``tree`` of a group is ``s`` and its name, or ``n`` for the null group.
    An empty table has no nodes.
    """
    leaves = staged_leaves(docs, fields, key, group)
    forest = grow(placed_leaves(leaves), fanout)
    upper = grow(placed_tops(forest), fanout)
    out = None
    for source, shift in ((forest, 0), (upper, len(forest.levels))):
        for level, nodes in enumerate(source.levels):
            name = F.col("tree") if source is forest else F.lit(None).cast("string")
            part = nodes.select(name.alias("tree"), F.lit(shift + level).alias("level"), "pos", "digest")
            out = part if out is None else out.unionByName(part)
    return out


def staged_leaves(docs: DataFrame, fields: tuple[str, ...], key: str, group: str, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, row, digest, other): the leaf of each row and, where ``where`` holds, that with ``changed`` fields."""
    name = F.col(group).cast("string")
    tree = F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name))
    values = [F.col(c) for c in fields]
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(F.lit(True) if where is None else where, leaf_of([changed.get(c, F.col(c)) for c in fields]))
    made = docs.select(tree.alias("tree"), F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), leaf_of(values).alias("digest"), other.alias("other"))
    return common.staged(made, "merkle-leaves")


def placed_leaves(leaves: DataFrame) -> DataFrame:
    return common.staged(placed(leaves, ["id", "digest", "row"]), "merkle-placed")


def placed_tops(forest: Forest) -> DataFrame:
    """The tops of all trees as leaves of one tree, ordered by name (the null group first)."""
    tops = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    return common.staged(placed(tops, ["name"]), "merkle-tops")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))


def proven(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row a document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A row's proof are the siblings from its run up to the root.  ``changed``
    (columns by field) tells a later state of the rows for which ``where``
    holds: the root folded from it and the original siblings shows whether the
    row is still the one in the manifest.

    Null fields are written ``-`` and an empty text ``0:``, so they differ.
    A null group is a group of its own and comes first; null ids come first
    within theirs.  Rows of one id stand in the order of their digests; equal
    rows are leaves of their own.  A table of one row has its leaf as root and
    an empty proof.  An empty table gives no rows.  Columns beside the fields
    are neither hashed nor returned.
    """
    leaves = placed_leaves(staged_leaves(docs, fields, key, group, changed, where))
    forest = grow(leaves, fanout)
    tops = placed_tops(forest)
    upper = grow(tops, fanout)
    root = upper.tops.select(F.col("tree"), F.col("digest").alias("root"))  # one row
    start = root.select("tree", F.expr(f"cast(array() as {PATH})").alias("path"), "root")
    over = paths(upper, start, fanout)
    met = with_siblings(runs_of(tops, fanout).join(over, ["tree", "run"]), fanout)
    step = F.array(F.struct("before", "after"))
    way = F.when(F.col("n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path"))
    above = common.staged(met.select(F.col("name").alias("tree"), way.alias("path"), F.col("digest").alias("subroot"), "root"), "merkle-above")
    run_paths = paths(forest, above, fanout)
    rows = with_siblings(runs_of(leaves, fanout).join(run_paths, ["tree", "run"]), fanout)
    rows = rows.withColumn("path", F.when(F.col("n") > 1, F.concat(step, F.col("path"))).otherwise(F.col("path")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    rows = rows.select(F.col("id"), F.col("digest").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("other", "digest"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later state lower-cases A-Z in the text of a fifth of the rows, by the checksum of their ids."""
    hit = F.coalesce(common.crc_mod("doc_id", 5) == 0, F.lit(False)) & F.col("doc_id").isNotNull()
    changed = {"text": F.translate("text", UPPER, UPPER.lower())}
    found = proven(common.table(spark, sf_dir, "documents"), changed=changed, where=hit)
    return found.withColumnRenamed("id", "doc_id")
