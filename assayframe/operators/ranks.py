"""Exact order statistics and running sums without a global sort.

A sketch of bounded size brackets the places in question, and only rows inside
the bracket, a thousandth of a large group, are put in order.
"""
from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged

#: groups up to which one row each is sent to all tasks
FEW_GROUPS = 10_000
#: rank error of the sketch is 1 / ACCURACY; the bracket reaches SLACK to both sides
ACCURACY = 10_000
SLACK = 1e-3
#: groups of so many rows are ordered as they are: their bracket is everything
SMALL = 5_000


def bracket(df: DataFrame, by: list[str], value: Column, level: float) -> DataFrame:
    """(by, n, lo, hi): the rows of a group and bounds that hold its ``level`` quantile between them."""
    share = [max(0.0, level - SLACK), min(1.0, level + SLACK)]
    got = df.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, share, ACCURACY).alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    small = F.col("n") <= SMALL
    return got.select(*by, "n", F.when(small, F.col("least")).otherwise(F.col("q")[0]).alias("lo"), F.when(small, F.col("most")).otherwise(F.col("q")[1]).alias("hi"))


def with_groups(left: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Join one row a group to the group's rows; a null group meets itself.

    The groups are written and counted, so it is they that are sent to all
    tasks, and only if they are few.  Left to estimates, the rows would be: a
    file of repeated values is far smaller than its rows in memory.
    """
    if not by:
        return left.crossJoin(F.broadcast(groups))  # one row
    names = {c: f"__by{i}" for i, c in enumerate(by)}
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    each = staged(groups.withColumnsRenamed(names), "groups")
    each = F.broadcast(each) if each.count() <= FEW_GROUPS else each.hint("merge")
    return left.join(each, same).drop(*names.values())


def exact_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of the values that are not null; groups without any are left out, a null group is one.

    Equal values are counted before they move, so ties cost nothing.
    """
    v = F.col(value)
    known = df.where(v.isNotNull()).select(*by, value)
    joined = with_groups(known, bracket(known, by, v, 0.5), by)
    inside = joined.where(v <= F.col("hi")).groupBy(*by, "n", F.when(v >= F.col("lo"), v).alias("x")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("x"))
    upto = inside.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # 1-based middle places
    at = lambda place: F.min(F.when(F.col("x").isNotNull() & (F.col("upto") >= place), F.col("x")))
    return upto.groupBy(*by).agg(((at(low) + at(high)) / 2).alias("median"))


def first_share(df: DataFrame, by: list[str], order: Column, ties: list[str], share: float) -> DataFrame:
    """Add ``n``, the group's rows, and ``first``: whether a row is among its group's first ceil(share n) by (order, ties).

    ``order`` is a number that a double holds exactly, and not null; a null
    group is a group.  Only keys
    inside the bracket are put in order, to find the last row that counts;
    the rows themselves are compared with it where they are.  Rows that equal
    it in order and ties count alike.
    """
    keyed = df.withColumn("__order", order.cast("double"))
    keys = staged(keyed.select(*by, "__order", *ties), "share-keys")
    found = bracket(keys, by, F.col("__order"), share)
    spread = with_groups(keys, found, by)
    below = spread.groupBy(*by, "n").agg(F.count_if(F.col("__order") < F.col("lo")).alias("below"))
    inside = spread.where(F.col("__order").between(F.col("lo"), F.col("hi"))).select(*by, "__order", *ties)
    window = Window.partitionBy(*by).orderBy("__order", *ties)
    placed = with_groups(inside.withColumn("__place", F.row_number().over(window)), below, by)
    last = F.col("below") + F.col("__place") == F.ceil(F.lit(share) * F.col("n"))
    edge = placed.groupBy(*by, "n").agg(F.min(F.when(last, F.struct("__order", *ties))).alias("__edge"))
    first = F.coalesce(F.struct("__order", *ties) <= F.col("__edge"), F.lit(False))
    return with_groups(keyed, edge, by).withColumn("first", first).drop("__order", "__edge")


def cut_points(df: DataFrame, order: str, parts: int = 64) -> list:
    """Values of ``order`` that part the rows about evenly, from a sample by hash of 32 rows a part."""
    n = df.count()
    step = max(1, n // (32 * parts))
    rows = df.where(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(step)) == 0)).select(order).distinct().orderBy(order).collect()
    return sorted({r[0] for r in rows[:: max(1, len(rows) // parts)]})


def running_before(df: DataFrame, order: str, values: list[str], parts: int = 64) -> DataFrame:
    """Add ``<value>_before``: the sum of each value over the rows that come before in ``order``, which has no repeats.

    Rows are parted at cut points and summed inside their part; the parts'
    totals, a few numbers each, give what lies before it.
    """
    cuts = cut_points(df, order, parts)
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    lots = df.withColumn("__part", part)
    totals = lots.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values]).orderBy("__part").collect()  # a row a part
    before, rows = [0] * len(values), []
    for r in totals:
        rows.append((r["__part"], *before))
        before = [b + (r[v] or 0) for b, v in zip(before, values)]
    kinds = ", ".join(f"__{v} {df.select(F.sum(v)).dtypes[0][1]}" for v in values)
    base = F.broadcast(df.sparkSession.createDataFrame(rows, f"__part int, {kinds}"))
    inner = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = lots.join(base, "__part")
    for v in values:
        out = out.withColumn(f"{v}_before", F.col(f"__{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0)))
    return out.drop("__part", *[f"__{v}" for v in values])
