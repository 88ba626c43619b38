"""Shared inputs of the registered queries, built once per (application, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators import clean as C
from parcelwise.plans import order_rows
from parcelwise.sources.store import frame
from parcelwise.sources.tables import read_table

orders_table = order_rows("orders_table")


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cod_raw", lambda: orders_table.raw_orders(spark, sf),
                 rows=lambda: read_table(spark, sf, "orders").count())


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cod_clean", lambda: C.clean_orders(raw(spark, sf)),
                 rows=lambda: raw(spark, sf).count())


def cod(spark: SparkSession, sf: str) -> DataFrame:
    return clean(spark, sf).where(F.col("IsCOD") == 1)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "cod_scored_sql", lambda: orders_table.rule_scored(cod(spark, sf)))
