"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
frame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import line_quality, mixing, neardup, packing, site_lines
from parcelwise.llm.common import DOCUMENT_COLUMNS, columns_of, documents
from parcelwise.llm.queries import WEIGHTS
from parcelwise.sources.scratch import Scratch

#: SQL cannot tokenise or pack; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = site_lines.drop_site_lines(columns_of(docs, *DOCUMENT_COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(columns_of(docs, *DOCUMENT_COLUMNS), width=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(columns_of(docs, *DOCUMENT_COLUMNS), WEIGHTS)


def pattern_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("source mix", source_mix), ("pattern packing", pattern_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read back."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
