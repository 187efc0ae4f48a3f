"""Validation of a compound table: coercion, quarantine, keep-first dedupe, counts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import generated_id, squeeze, to_number
from ..sources.tables import staged
from .ranks import exact_median

META = ("compound_id", "canonical_smiles", "activity", "original_row_index")


def require_columns(df: DataFrame, *names: str | None) -> None:
    lost = [n for n in names if n and n not in df.columns]
    if lost:
        raise ValueError(f"Column(s) not found: {', '.join(lost)}")


def mark(df: DataFrame, structure: str, activity: str, compound_id: str | None = None, ordinal: str = "original_row_index", canonical: Callable[[Column], Column] = squeeze) -> DataFrame:
    """Add the four meta columns, ``structure_key`` and ``bad_activity``, ``bad_structure``.

    The key is a SHA-256 of the canonical structure: rows are grouped and
    joined on it, so long structures do not move with the shuffles.

    A structure that ``canonical`` turns to null or nothing is bad; infinite
    activity counts as bad, as does text that is no number.
    """
    require_columns(df, structure, activity, compound_id, ordinal)
    row = F.col(ordinal).cast("long")
    cid = F.col(compound_id).cast("string") if compound_id else generated_id(row)
    once = df.withColumn("__canon", canonical(F.col(structure).cast("string")))
    marked = once.select(
        "*", cid.alias("__id"), F.when(F.col("__canon") != "", F.col("__canon")).alias("__structure"),
        to_number(F.col(activity).cast("string")).alias("__activity"), row.alias("__row"),
    )
    added = ("__canon", "__id", "__structure", "__activity", "__row", "structure_key", "bad_activity", "bad_structure")
    kept = [c for c in df.columns if c not in (*META, *added)]
    return marked.select(
        *kept, F.col("__id").alias("compound_id"), F.col("__structure").alias("canonical_smiles"), F.sha2("__structure", 256).alias("structure_key"), F.col("__activity").alias("activity"), F.col("__row").alias("original_row_index"),
        F.col("__activity").isNull().alias("bad_activity"), F.col("__structure").isNull().alias("bad_structure"),
    )


def bad() -> Column:
    return F.col("bad_activity") | F.col("bad_structure")


def quarantine(marked: DataFrame) -> DataFrame:
    return marked.where(bad())


def ranked(marked: DataFrame) -> DataFrame:
    """Valid rows with their place among those of one structure, in input order."""
    w = Window.partitionBy("structure_key").orderBy("original_row_index")
    return marked.where(~bad()).withColumn("copy", F.row_number().over(w))


def keep_first(marked: DataFrame) -> DataFrame:
    """First row of each structure.

    A minimum over a struct aggregates before the shuffle, so a structure that
    a third of all rows share sends one row a task, unlike a window.
    """
    rest = F.struct("original_row_index", "compound_id", "activity")
    first = marked.where(~bad()).groupBy("structure_key").agg(F.min(rest).alias("r"), F.min_by("canonical_smiles", "original_row_index").alias("canonical_smiles"))
    return first.select("r.compound_id", "canonical_smiles", "r.activity", "r.original_row_index")


def duplicates(marked: DataFrame) -> DataFrame:
    """Rows after the first of their structure; only structures that repeat are joined back."""
    valid = marked.where(~bad())
    first = valid.groupBy("structure_key").agg(F.min("original_row_index").alias("first_row"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return valid.join(first, "structure_key").where("original_row_index > first_row")


def counts(marked: DataFrame) -> DataFrame:
    """One row of counts; a row bad in both ways is in both counts."""
    valid = F.when(~bad(), F.col("structure_key"))
    return marked.agg(
        F.count("*").alias("original_rows"), F.count_if("bad_structure").alias("invalid_structures"), F.count_if("bad_activity").alias("invalid_activities"),
        F.countDistinct(valid).alias("valid_rows"), (F.count(valid) - F.countDistinct(valid)).alias("duplicates"),
    )


def activity_stats(clean: DataFrame) -> DataFrame:
    a = F.col("activity")
    middle = exact_median(clean, [], "activity").select(F.round("median", 6).alias("median_activity"))
    rest = clean.agg(F.count("*").alias("n"), F.min(a).alias("min_activity"), F.max(a).alias("max_activity"), F.round(F.avg(a), 6).alias("mean_activity"), F.round(F.stddev_samp(a), 6).alias("std_activity"))
    return rest.withColumn("__one", F.lit(1)).join(middle.withColumn("__one", F.lit(1)), "__one", "left").select("n", "min_activity", "max_activity", "mean_activity", "median_activity", "std_activity")


def validate(df: DataFrame, structure: str, activity: str, compound_id: str | None = None, min_valid: int = 20, **kw) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(clean, invalid, duplicate) tables and the report; raises on too few."""
    marked = staged(mark(df, structure, activity, compound_id, **kw), "marked")
    clean = staged(keep_first(marked), "clean")
    report = {**counts(marked).first().asDict(), **activity_stats(clean).first().asDict()}
    if report["valid_rows"] < min_valid:
        raise ValueError(f"Too few valid compounds: {report['valid_rows']} < {min_valid}")
    return clean, quarantine(marked), duplicates(marked), report
