"""Partial aggregates per input file: a folder with one new file is brought up to date by scanning
that file alone.

The folder holds Parquet files of clean orders. A refresh compares their names, sizes and times
with the manifest of the state folder and aggregates the new and changed files in one scan
(grouping sets): one row per (file, shopper) and one per (file, combination of traits), with counts
and sums, which merge by addition. Partial rows of removed and replaced files stay on disk, but the
manifest names the batch that holds a file's valid rows, and readers take only those. ``compact``
rewrites the valid rows as one batch.

A batch is written before the manifest that names it, and each manifest is a new folder, so a
refresh that is cut short changes nothing; of two refreshes at the same time the second fails.

Defined cases: an empty folder has no orders (rates are null, no shoppers); empty files count as
seen; rows without a shopper count as orders but not as shoppers; null levels are dropped; further
columns are ignored. Rows are counted per file: orders must be free of copies across files.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelwise.operators.describe import R6

# The traits that rates are shown by and the numbers that are averaged.
TRAITS = ["PaymentMethod", "CityTier", "Category", "AddressQuality", "Device", "IsCOD"]
NUMBERS = ["OrderValue", "DiscountPct", "IsCOD", "RTO"]
MANIFEST = "file string, stamp string, batch string"
#: Local addresses have one slash or three.
_ONE_FORM = ("^file:/+", "file:/")
_SHOPPERS, _TRAITS = "shoppers", "traits"


class Partials:
    """The partial aggregates of ``folder``, kept in ``state`` (both on a file system that all
    executors see)."""

    def __init__(self, spark: SparkSession, folder: str, state: str, schema: StructType):
        self.spark, self.folder, self.state = spark, folder, state.rstrip("/")
        wanted = {*TRAITS, *NUMBERS, "CustomerID"}
        self.schema = StructType([f for f in schema if f.name in wanted])

    def _listed(self, folder: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return list(store.listStatus(path)) if store.exists(path) else []

    def _files(self) -> dict[str, str]:
        """Stamp per data file, by its address as Spark's reader names it."""
        found, todo = {}, [self.folder]
        while todo:
            for f in self._listed(todo.pop()):
                name = f.getPath().getName()
                if f.isDirectory() and not name.startswith(("_", ".")):
                    todo.append(f.getPath().toString())
                elif name.endswith(".parquet") and not name.startswith(("_", ".")):
                    found[re.sub(*_ONE_FORM, f.getPath().toUri().toString())] = f"{f.getLen()}|{f.getModificationTime()}"
        return found

    def _version(self) -> int:
        """The last whole manifest (0: none)."""
        names = [f.getPath().getName() for f in self._listed(f"{self.state}/manifest")]
        return max((int(n) for n in names if self._listed(f"{self.state}/manifest/{n}/_SUCCESS")), default=0)

    def manifest(self) -> DataFrame:
        """(file, stamp, batch) of the files that count."""
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.state}/manifest/{version:09d}")

    def _record(self, version: int, rows: list[tuple[str, str, str]]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.state}/manifest/{version:09d}")

    def refresh(self) -> list[str]:
        """Brings the state up to date; returns the files that were scanned."""
        version, now = self._version(), self._files()
        known = {r["file"]: (r["stamp"], r["batch"]) for r in self.manifest().collect()}  # one row a file
        new = sorted(f for f, stamp in now.items() if known.get(f, ("",))[0] != stamp)
        if not new and set(now) == set(known):
            return []
        batch = uuid.uuid4().hex
        if new:
            self._aggregate(new).withColumn("batch", F.lit(batch)).write.parquet(f"{self.state}/batch-{batch}")
        self._record(version + 1, [(f, stamp, batch if f in new else known[f][1]) for f, stamp in sorted(now.items())])
        return new

    def _aggregate(self, files: list[str]) -> DataFrame:
        jvm = self.spark._jvm  # addresses are escaped, the reader's paths are not
        paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files]
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        # the columns that are grouped by are copies, as grouping sets blank them
        keys = [F.col(t).alias(f"by_{t}") for t in TRAITS]
        rows = rows.select(F.regexp_replace("_metadata.file_path", *map(F.lit, _ONE_FORM)).alias("file"), "CustomerID", *keys, *NUMBERS)
        traits = [F.col(f"by_{t}") for t in TRAITS]
        sums = [a for c in NUMBERS for a in (F.sum(F.col(c).cast("double")).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
        made = rows.groupingSets([[F.col("file"), F.col("CustomerID")], [F.col("file"), *traits]], "file", "CustomerID", *traits) \
            .agg(F.grouping("CustomerID").alias("blank"), F.count(F.lit(1)).alias("n"), *sums)
        return made.withColumn("grain", F.when(F.col("blank") == 0, _SHOPPERS).otherwise(_TRAITS)).drop("blank")

    def _live(self, grain: str) -> DataFrame:
        """The valid partial rows; the manifest has a row per file and stays unhinted."""
        batches = sorted(r["batch"] for r in self.manifest().select("batch").distinct().collect())
        paths = [f"{self.state}/batch-{b}" for b in batches]
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        layout = ", ".join(["file string", f"CustomerID {kinds['CustomerID']}", *[f"by_{t} {kinds[t]}" for t in TRAITS], "n long",
                            *[f"sum_{c} double, n_{c} long" for c in NUMBERS], "grain string", "batch string"])
        rows = self.spark.read.schema(layout).parquet(*paths) if paths else self.spark.createDataFrame([], layout)
        return rows.where(F.col("grain") == grain).join(self.manifest().select("file", "batch"), ["file", "batch"], "left_semi")

    def compact(self) -> None:
        """Rewrites the valid rows as one batch."""
        version, batch = self._version(), uuid.uuid4().hex
        known = self.manifest().collect()
        if not known:
            return
        self._live(_SHOPPERS).unionByName(self._live(_TRAITS)).withColumn("batch", F.lit(batch)) \
            .write.parquet(f"{self.state}/batch-{batch}")
        self._record(version + 1, [(r["file"], r["stamp"], batch) for r in known])

    def customer_table(self) -> DataFrame:
        """As ``describe.customer_table``: one row per shopper."""
        rows = self._live(_SHOPPERS).where(F.col("CustomerID").isNotNull())
        names = dict(zip(NUMBERS, ["AvgValue", "AvgDiscount", "PctCOD", "ReturnRate"], strict=True))
        return rows.groupBy("CustomerID").agg(F.sum("n").alias("Orders"), *[_mean(c).alias(name) for c, name in names.items()])

    def kpi_headline(self) -> DataFrame:
        """As ``describe.kpi_headline``."""
        rows = self._live(_TRAITS)
        cod = F.col("by_IsCOD") == 1
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.round(_mean("RTO"), R6).alias("overall_rate"),
                        F.round(_mean("RTO", cod), R6).alias("cod_rate"), F.round(_mean("RTO", ~cod), R6).alias("prepaid_rate")) \
            .withColumn("shoppers", self._live(_SHOPPERS).agg(F.countDistinct("CustomerID")).scalar())

    def rate_by(self, trait: str, cod_only: bool = False, min_n: int = 20) -> DataFrame:
        """As ``describe.rate_by`` for one of ``TRAITS``, over all or COD orders; the order is that of
        the levels, which are few."""
        rows = self._live(_TRAITS)
        rows = rows.where(F.col("by_IsCOD") == 1) if cod_only else rows
        overall = rows.agg(_mean("RTO")).scalar()
        per = rows.where(F.col(f"by_{trait}").isNotNull()).groupBy(F.col(f"by_{trait}").alias(trait)) \
            .agg(_mean("RTO").alias("mean"), F.sum("n").alias("n")).where(F.col("n") >= min_n).withColumn("overall", overall)
        rate = F.round("mean", R6)
        return per.select(
            trait, rate.alias("return_rate"), "n", F.round("overall", R6).alias("overall_rate"),
            F.when(F.col("mean") > F.col("overall"), "above").otherwise("below").alias("vs_overall"),
            F.row_number().over(Window.orderBy(rate, trait)).cast("bigint").alias("display_rank"))


def _mean(column: str, where: Column | None = None) -> Column:
    def part(name: str) -> Column:
        return F.sum(F.col(name) if where is None else F.when(where, F.col(name)))
    return F.try_divide(part(f"sum_{column}"), part(f"n_{column}"))
