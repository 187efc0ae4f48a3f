"""Column expressions shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)


def to_number(col: Column) -> Column:
    """Numeric coercion: text that is no finite number is null."""
    return finite(col.try_cast("double"))


def inactive(col: Column, mark: str = "ni") -> Column:
    """0 where a response is the mark of no activity, else 1; null stays null."""
    return F.when(col.isNull(), None).when(col == mark, 0).otherwise(1)


def measured(col: Column, mark: str = "ni") -> Column:
    """The number of a measured response, written plainly or as a quotient of two numbers.

    Null where it is the mark of no activity, 0, or no number; rows of a
    regression are those that are not null.
    """
    text = strip_id(col)
    parts = F.split(text, "/", 2)
    value = F.when(F.size(parts) == 2, F.try_divide(to_number(F.trim(parts[0])), to_number(F.trim(F.get(parts, F.lit(1)))))).otherwise(to_number(text))
    return F.when((text != mark) & (value != 0), finite(value))


def strip_id(col: Column) -> Column:
    """An id as text without white space at either end."""
    return F.regexp_replace(col.cast("string"), r"^\s+|\s+$", "")


def squeeze(col: Column) -> Column:
    """The text stand-in for a canonical structure: lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def generated_id(row: Column) -> Column:
    return F.concat(F.lit("compound_"), row.cast("string"))


def molecule_file_id(row: Column) -> Column:
    return F.format_string("mol_%04d", row + 1)


def safe_run_id(col: Column) -> Column:
    return col.rlike(r"^[a-zA-Z0-9_\-\.]+$")


def r6(col: Column) -> Column:
    return F.round(col, 6)
