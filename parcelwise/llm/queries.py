"""The training-data operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import (
    chat,
    html_cut,
    lexical,
    line_quality,
    merkle,
    mixing,
    neardup,
    packing,
    rule_ensemble,
    site_lines,
    spotsigs,
    token_scan,
    warc,
)
from parcelwise.llm.common import documents, table

WEIGHTS = [3, 1, 2]


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(documents(spark, sf_dir))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.document_token_counts(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir), WEIGHTS)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op6_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract(table(spark, sf_dir, "pages"))


def op7_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = site_lines.drop_site_lines(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped_lines", F.length("text").cast("long").alias("kept_chars"),
                       F.md5("text").alias("kept_md5"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


def op10_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.write_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_pattern_packing, op2_line_quality, op3_separator_scan, op4_source_mix, op5_chosen_path, op6_min_cut,
    op7_site_lines, op8_chat_format, op9_spot_signatures, op10_capture_index,
    op11_rule_ensemble, op12_block_max_search, op13_interval_manifest)}
