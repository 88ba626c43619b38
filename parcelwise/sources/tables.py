"""Column-pruned readers for the parquet test tables.

Each reader selects only the columns the order fixture needs, so the parquet scan's
``ReadSchema`` stays narrow no matter how wide the table is.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
               "o_totalprice", "o_orderdate"],
    "customer": ["c_custkey", "c_nationkey"],
    "nation": ["n_nationkey", "n_regionkey", "n_name"],
    "lineitem": ["l_orderkey", "l_partkey", "l_discount"],
    "part": ["p_partkey", "p_type"],
    "embeddings": ["vec_id", "embedding", "label"],
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    cols = columns if columns is not None else TABLE_COLUMNS.get(name)
    return df.select(*cols) if cols else df
