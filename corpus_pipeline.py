"""From raw documents to packed training sequences, in five stages.

Each stage takes the rows that its predecessor kept, as (spark, docs, sf_dir), and
returns a frame; what it returns is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.

Intermediate tables of a stage go once a later stage starts: by then its result
has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from astrolane.llm import op4_secret_scans, op5_exact_dedup, op6_quality_rules, op7_jaccard_join, op9_best_fit_packing
from astrolane.llm.common import Scratch, table

_held: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A folder for this stage; those of earlier stages go."""
    while _held:
        _held.pop().drop()
    _held.append(Scratch(spark, name))
    return _held[-1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    _scratch(spark, "quality")
    return op6_quality_rules.clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return op5_exact_dedup.drop_exact(docs, scratch=_scratch(spark, "exact"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, directly or through others, one stays."""
    return op7_jaccard_join.drop_near(docs, width=5, num=80, den=100, scratch=_scratch(spark, "near"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    _scratch(spark, "secrets")
    return op4_secret_scans.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the sequences that hold them."""
    return op9_best_fit_packing.pack(docs, 1024, 2, scratch=_scratch(spark, "packing"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the tokens of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    between = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = between.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
