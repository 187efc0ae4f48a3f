"""Left join of external descriptors, with a fallback key and overlap reports."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_id, to_number
from ..sources.tables import staged
from .clean import META

#: the order of an external table's rows, unless another column is named
ORDINAL = "external_row_index"
STRUCTURE_ALIASES = ("smiles", "SMILES", "Smiles")
ID_NAMES = ("compound_id", "Compound_ID", "CompoundID", "id", "ID", "mol_id", "name", "Name")


@dataclass
class Merge:
    table: DataFrame
    key: str
    features: list[str]
    warnings: list[str] = field(default_factory=list)


def suggest_id_column(columns: list[str]) -> str | None:
    """The first known id name, then the first that matches without case."""
    for name in ID_NAMES:
        if name in columns:
            return name
    lower = {c.lower(): c for c in reversed(columns)}
    return next((lower[n.lower()] for n in ID_NAMES if n.lower() in lower), None)


def keep_first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the least by ``order``; null keys go."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return first.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def overlap(left: DataFrame, right: DataFrame, key: str) -> int:
    """Distinct keys of the left side that the right side has."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi").count()


def examples(left: DataFrame, right: DataFrame, key: str, n: int = 5) -> list[str]:
    rows = left.select(key).distinct().join(right.select(key), key, "left_anti").orderBy(key).limit(n).collect()
    return [r[0] for r in rows]


def merge_external(
    generated: DataFrame, external: DataFrame, ordinal: str | None = None, canonical: Callable[[Column], Column] | None = None
) -> Merge:
    """Left join on compound_id, or on the structure where no id matches.

    ``canonical`` brings the external structures into the form of
    ``canonical_smiles``; without it they are taken as they are written, less
    outer white space.  Structures that it turns to null match nothing.

    The side joined is keyed once and left to the optimizer: it is broadcast
    only if its measured size allows.  Of rows with one key the first by
    ``ordinal`` (or ORDINAL, which readers can add) stays; a table without any
    has no order, and there the least row by its values stays.
    """
    if "compound_id" not in external.columns:
        raise ValueError(f"External table needs a compound_id column; did you mean {suggest_id_column(external.columns)!r}?")
    order = ordinal or (ORDINAL if ORDINAL in external.columns else "__order")
    if order not in external.columns:
        external = external.withColumn(order, F.lit(0))
    alias = next((c for c in STRUCTURE_ALIASES if c in external.columns), None)
    drop = [c for c in external.columns if c in META and c != "compound_id"]
    features = [c for c in external.columns if c not in (*META, alias, order)]
    if not features:
        raise ValueError("External table has no descriptor column")
    names = {c: f"ext__{c}" if c in generated.columns else c for c in features}
    ext = external.drop(*drop).select(
        strip_id(F.col("compound_id")).alias("compound_id"), *([strip_id(F.col(alias)).alias("__structure")] if alias else []), order,
        *[to_number(F.col(c).cast("string")).alias(n) for c, n in names.items()],
    )
    gen = generated.withColumn("compound_id", strip_id(F.col("compound_id")))
    warnings = [f"renamed {c} to {n}" for c, n in names.items() if c != n]
    key, right = "compound_id", keep_first_by(ext.drop("__structure"), "compound_id", order)
    matched = overlap(gen, right, key)
    if not matched and alias:
        key = "canonical_smiles"
        by_structure = ext.drop("compound_id").withColumnRenamed("__structure", key)
        if canonical is not None:
            by_structure = staged(by_structure.withColumn(key, canonical(F.col(key))), "external-structures")
        right = keep_first_by(by_structure, key, order)
        matched = overlap(gen, right, key)
        if matched:
            warnings.append(f"no compound_id matched; joined on structure ({matched} matched)")
    if not matched:
        raise ValueError(f"no matching compound_id; examples: {examples(gen, right, key)} against {examples(right, gen, key)}")
    if key == "compound_id":
        for a, b, text in ((gen, right, "without external row"), (right, gen, "external only")):
            if lost := examples(a, b, key):
                warnings.append(f"{text}: {', '.join(map(str, lost))}")
    if matched < 0.5 * gen.count():
        warnings.append("fewer than half of the compounds matched")
    return Merge(gen.join(right, key, "left"), key, list(names.values()), warnings)


def overlap_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, matched keys, matched share, those of the right alone."""
    l = left.groupBy(key).agg(F.count("*").alias("n"))
    r = right.select(key).distinct().withColumn("r", F.lit(True))
    both = l.join(r, key, "full_outer")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("left_rows"), F.count("n").alias("left_keys"), F.count_if(F.col("n").isNotNull() & F.col("r").isNotNull()).alias("matched_keys"),
        F.count_if(F.col("n").isNull()).alias("right_only"),
    ).withColumn("matched_share", F.round(F.try_divide("matched_keys", "left_rows"), 6))
