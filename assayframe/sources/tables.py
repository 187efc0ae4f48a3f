"""Readers and writers: CSV as text columns with a stable ordinal, JSON, Parquet."""
from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, ordinal: str | None = "original_row_index") -> DataFrame:
    """Every column as text, so ids keep leading zeros; numbers are coerced later.

    The ordinal is the row's place in file order.  Its gapless form needs one
    count per partition; the partitions' counts go to the driver, no rows do.
    """
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    return with_ordinal(df, ordinal) if ordinal else df


def with_ordinal(df: DataFrame, name: str) -> DataFrame:
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    counts = tagged.groupBy(F.shiftright("__id", 33).alias("part")).count().collect()
    offsets, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        offsets[r["part"]], total = total, total + r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    base = df.sparkSession.createDataFrame(sorted(offsets.items()), "__part long, __base long")
    inner = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(base), "__part")
        .withColumn(name, F.col("__base") + inner).drop("__id", "__part", "__base")
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def schema_only(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV; reads the header line and no data."""
    return spark.read.option("header", True).csv(path).columns


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    return df.limit(rows)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_json(path: str | Path, data: dict) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, default=str))


def staged_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh place in ``folder`` or in ``spark.checkpoint.dir``.

    Only a session on one machine that names neither gets a temporary folder.
    """
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assayframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stages/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table written as Parquet and read back: later stages neither repeat its work nor carry its plan."""
    path = staged_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
