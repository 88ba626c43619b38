"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.sources.scratch import Scratch

#: One word: a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by exact name: other columns of a table, also those whose
    names differ only in case, cannot clash with the ones an operator adds."""
    frame = df.toDF(*[str(i) for i in range(len(df.columns))])
    return frame.select(*[F.col(str(df.columns.index(n))).alias(n) for n in names])


def fresh_name(df: DataFrame, base: str) -> str:
    """``base`` or a longer name that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` over batches, one result batch (or several) per batch."""
    def run(batches):
        for batch in batches:
            out = work(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory of this worker process back to the system. Workers wait idle between
    stages, and what they hold counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def frees_memory(run: Callable) -> Callable:
    """A batch function whose worker gives its freed memory back when the task ends."""
    def task(batches):
        yield from run(batches)
        release_memory()
    return task


def ranked(df: DataFrame, order: list, scratch: Scratch, rank: str) -> DataFrame:
    """``df`` with its 0-based position in the order ``order``, without one global sort task.

    Rows are dealt to key ranges, counted per range, and numbered inside each range; only
    one row per range meets in a single task. The dealt rows are written once, so that the
    ranges cannot move between the two readings.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = fresh_name(df, "part")
    dealt = df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    dealt = scratch.table(dealt, "ranked")
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("rows_here"))
    before = F.sum("rows_here").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col(part).alias("range_no"), F.coalesce(before, F.lit(0)).alias("range_start"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    numbered = dealt.withColumn(rank, inside.cast("long"))
    return (numbered.join(F.broadcast(starts), F.col(part) == F.col("range_no"))
            .withColumn(rank, F.col(rank) - 1 + F.col("range_start"))
            .drop(part, "range_no", "range_start"))


def as_uri(path: str) -> str:
    return path if re.match(r"^[a-z][a-z0-9+.-]*:", path) else "file://" + os.path.abspath(path)
