"""Intermediate tables in the cluster's shared folder (``spark.checkpoint.dir``).

``Scratch`` writes each table under a name of its own (never overwritten while a reader is
alive), reads it back, and deletes it through the Hadoop file system when told to, or all
of them when the application ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from parcelwise.session import ensure_checkpoint_dir


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system ``path`` names; no error if it is gone."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop, True)


class Scratch:
    """A fresh folder for the tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = ensure_checkpoint_dir(spark).rstrip("/")
        self.root = f"{base}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{name}-{self._count}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of the written table (its lineage is cut)."""
        return self.blocks(df, name, 0)

    def blocks(self, df: DataFrame, name: str, file_rows: int) -> DataFrame:
        """Like ``table``, with files of at most ``file_rows`` rows (0: as they come)."""
        path = self.path(name)
        df.write.option("maxRecordsPerFile", file_rows).parquet(path)
        schema = StructType.fromJson(df.schema.jsonValue())
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def dealt(self, df: DataFrame, name: str, file_rows: int) -> DataFrame:
        """Like ``table``, with the rows dealt out evenly: one file a core at least and ``file_rows``
        rows a file at most, so that every pass keeps all cores busy, however few files ``df`` has."""
        return self.blocks(df.repartition(self.spark.sparkContext.defaultParallelism), name, file_rows)

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            if df is not None:
                delete_path(self.spark, df.scratch_path)

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session is already stopped
            return
