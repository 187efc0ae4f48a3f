"""Rows at fixed places, so that decisions reach long rows without moving them.

A table is written once, bucketed by runs of its rows.  What is decided on
keys comes back as a list of rows for each run, at most CHUNK of them, and is
joined run by run: the lists move, the rows do not, at every size.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: rows of a run, as a power of two
CHUNK_BITS = 12


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@dataclass
class Placed:
    """``table`` holds the rows of ``source``, ``row`` names the column of their numbers and ``run`` that of their runs."""

    source: DataFrame
    table: DataFrame
    columns: list[str]
    row: str
    run: str
    name: str

    def _lists(self, rows: DataFrame, row: str) -> DataFrame:
        run, row_ = F.shiftright(row, CHUNK_BITS).alias(self.run), F.col(row).alias("r")
        return rows.select(run, row_).groupBy(self.run).agg(F.collect_set("r").alias("listed_rows"))

    def _met(self, rows: DataFrame, row: str, how: str, numbered: bool = False) -> DataFrame:
        left, right = self.table.alias("l"), self._lists(rows, row).alias("r")
        same = F.col(f"l.`{self.run}`") == F.col(f"r.`{self.run}`")
        listed = F.array_contains(F.col("r.listed_rows"), F.col(f"l.`{self.row}`"))
        return left.join(right, same & listed, how).select(*[F.col(f"l.`{c}`") for c in [*self.columns, *[self.row] * numbered]])

    def only(self, rows: DataFrame, row: str = "row", numbered: bool = False) -> DataFrame:
        """The rows whose numbers ``rows`` lists; with the column ``row`` if ``numbered``."""
        return self._met(rows, row, "left_semi", numbered)

    def without(self, rows: DataFrame, row: str = "row") -> DataFrame:
        """The rows whose numbers ``rows`` does not list."""
        return self._met(rows, row, "left_anti")

    def discard(self) -> None:
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        common.discard(self.table)


def placed(docs: DataFrame, name: str) -> Placed:
    """Write ``docs`` bucketed by runs; rows keep the files of the tasks that read them."""
    spark = docs.sparkSession
    columns = list(docs.columns)
    row, run = fresh([*columns, "listed_rows"], "row_number", "row_run")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    numbered = numbered.withColumn(run, F.shiftright(row, CHUNK_BITS))
    path, table = common.staged_path(spark, name), f"assayframe_{uuid.uuid4().hex}"
    numbered.write.format("parquet").option("path", path).bucketBy(common.parts(spark), run).saveAsTable(table)
    out = spark.table(table)
    out._staged_path = path
    return Placed(docs, out, columns, row, run, table)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns that can be hashed, to order rows alike on every run."""
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return F.xxhash64(*plain)
