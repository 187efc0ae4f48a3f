"""Corpus pipeline: STAGES applied one after another to ``documents``.

Each stage is written as Parquet in the shared folder and read again, so a
lost executor repeats at most the stage it was in.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import common
from assayframe.llm.decontam import decontamination_stage
from assayframe.llm.jaccard import near_duplicate_stage
from assayframe.llm.pieces import encoding_stage
from assayframe.llm.quality import quality_stage
from assayframe.llm.surrogates import surrogate_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality classifier rejects go."""
    return quality_stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the least doc_id of each group of near copies stays."""
    return near_duplicate_stage(spark, docs, sf_dir)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontamination_stage(spark, docs, sf_dir)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data gets surrogates; n_chars follows."""
    return surrogate_stage(spark, docs, sf_dir)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of what is left."""
    return encoding_stage(spark, docs, sf_dir)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("encoding", encoding),
]

#: no stage but the removal of rows can be written in SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last one's rows."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
