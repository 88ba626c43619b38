"""Partial aggregates per file: refreshed equals rebuilt, and only what changed is scanned."""

import pytest
from pyspark.sql import functions as F

from parcelwise.operators import describe as D
from parcelwise.operators.partials import Partials

SCHEMA = ("OrderID string, CustomerID string, PaymentMethod string, CityTier string, Category string, AddressQuality string, "
          "Device string, IsCOD int, OrderValue double, DiscountPct double, RTO int, Extra string")


def _orders(spark, first, last):
    def pick(*levels):
        return F.element_at(F.array(*[F.lit(v) for v in levels]), (F.pmod(F.hash("id"), F.lit(len(levels))) + 1).cast("int"))
    return spark.range(first, last).select(
        F.col("id").cast("string").alias("OrderID"), F.when(F.col("id") % 11 > 0, F.concat(F.lit("c"), F.col("id") % 37)).alias("CustomerID"),
        F.when(F.col("id") % 3 == 0, "COD").otherwise(pick("UPI", "Card")).alias("PaymentMethod"), pick("T1", "T2", None).alias("CityTier"),
        pick("A", "B", "C").alias("Category"), pick("Complete", "Vague").alias("AddressQuality"), pick("App", "Web").alias("Device"),
        (F.col("id") % 3 == 0).cast("int").alias("IsCOD"), (F.col("id") % 97 + 0.25).alias("OrderValue"),
        F.when(F.col("id") % 5 > 0, (F.col("id") % 60).cast("double")).alias("DiscountPct"),
        (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).cast("int").alias("RTO"), F.lit("x").alias("Extra"))


def _rows(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v
    return sorted(map(str, [{k: plain(v) for k, v in sorted(r.asDict().items())} for r in df.collect()]))


def _same(p, spark, folder):
    rows = spark.read.schema(SCHEMA).parquet(folder)
    assert _rows(p.kpi_headline()) == _rows(D.kpi_headline(rows))
    assert _rows(p.customer_table()) == _rows(D.customer_table(rows))
    assert _rows(p.rate_by("PaymentMethod")) == _rows(D.rate_by(rows, "PaymentMethod", level_name="PaymentMethod"))
    assert _rows(p.rate_by("CityTier", True, 5)) == _rows(D.rate_by(rows.where("IsCOD = 1"), "CityTier", 5, "CityTier"))


@pytest.fixture
def kept(spark, tmp_path):
    folder, state = f"{tmp_path}/orders in", f"{tmp_path}/state"  # a space in the name
    _orders(spark, 0, 400).repartition(3).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    return folder, Partials(spark, folder, state, schema)


def test_refreshed_equals_rebuilt(spark, kept):
    folder, p = kept
    assert len(p.refresh()) == 3
    _same(p, spark, folder)
    assert p.refresh() == []
    _orders(spark, 400, 700).coalesce(1).write.mode("append").parquet(folder)
    scanned = p.refresh()
    assert len(scanned) == 1  # the new file alone
    _same(p, spark, folder)
    p.compact()
    _same(p, spark, folder)
    assert p.refresh() == [] and p.manifest().select("batch").distinct().count() == 1


def test_removed_and_replaced_files(spark, kept, tmp_path):
    folder, p = kept
    p.refresh()
    jvm = spark._jvm.org.apache.hadoop.fs
    names = sorted(r["file"] for r in p.manifest().collect())
    store = jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(jvm.Path(spark._jvm.java.net.URI(names[0])), False)
    other = f"{tmp_path}/other"
    _orders(spark, 900, 950).coalesce(1).write.parquet(other)
    (new,) = [f.getPath() for f in store.listStatus(jvm.Path(other)) if f.getPath().getName().endswith(".parquet")]
    store.delete(jvm.Path(spark._jvm.java.net.URI(names[1])), False)
    store.rename(new, jvm.Path(spark._jvm.java.net.URI(names[1])))
    spark.catalog.refreshByPath(folder)
    assert p.refresh() == [names[1]]
    _same(p, spark, folder)


def test_a_refresh_cut_short_changes_nothing(spark, kept, monkeypatch):
    folder, p = kept
    p.refresh()
    before = _rows(p.kpi_headline())
    _orders(spark, 400, 500).coalesce(1).write.mode("append").parquet(folder)
    monkeypatch.setattr(p, "_record", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        p.refresh()
    assert _rows(p.kpi_headline()) == before
    monkeypatch.undo()
    assert len(p.refresh()) == 1
    _same(p, spark, folder)


def test_empty_folder(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    p = Partials(spark, f"{tmp_path}/none", f"{tmp_path}/state", schema)
    assert p.refresh() == []
    (row,) = p.kpi_headline().collect()
    assert (row["orders"], row["shoppers"], row["overall_rate"]) == (0, 0, None)
    assert p.customer_table().collect() == [] and p.rate_by("Category").collect() == []
    p.compact()
