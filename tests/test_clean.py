import pytest
from pyspark.sql import functions as F

from parcelwise.operators import clean as C
from parcelwise.sources.scratch import Scratch
from parcelwise.sources.io import RAW_SCHEMA


def _raw(spark, rows):
    base = dict(OrderID="ORD1", CustomerID="CUST1", OrderDay=1, CityTier="Tier 1", State="Goa",
                Category="A", OrderValue="1,000", DiscountPct="10%", PaymentMethod="COD",
                Device=None, AddressQuality="Vague", OrderHour=3, Items=1, PriorOrders=0,
                PriorReturns=0, DeliveryStatus="Returned")
    data = []
    for r in rows:
        d = dict(base, **r)
        data.append(tuple(d[f.name] for f in RAW_SCHEMA.fields))
    return spark.createDataFrame(data, RAW_SCHEMA)


def test_dedup_exact_copies_with_nulls_only(spark):
    raw = _raw(spark, [{}, {}, {"State": "GOA"}])  # two exact copies (NULL device), one spelling variant
    assert C.dedup(raw).count() == 2
    # after normalising, the spelling variant would also collapse
    assert C.clean_orders(raw, dedup_after=True).count() == 1


@pytest.mark.parametrize("discounts,median", [(["1", "2", "3", "10", "150%"], 2.5),
                                              (["1", "2", "3", "999%"], 2.0)])
def test_cap_discount_exact_median(spark, discounts, median):
    raw = _raw(spark, [{"OrderID": f"ORD{i}", "DiscountPct": d} for i, d in enumerate(discounts)])
    out = {r.OrderID: r.DiscountPct for r in C.clean_orders(raw).collect()}
    assert out[f"ORD{len(discounts) - 1}"] == median


def test_flags_and_drop(spark):
    raw = _raw(spark, [{"OrderID": "ORD1", "PriorOrders": 4, "PriorReturns": 1},
                       {"OrderID": "ORD2", "OrderValue": "abc"},
                       {"OrderID": "ORD3", "PaymentMethod": "Prepaid", "DeliveryStatus": "Delivered"}])
    rows = {r.OrderID: r for r in C.clean_orders(raw).collect()}
    assert set(rows) == {"ORD1", "ORD3"}
    assert rows["ORD1"].PriorRTORate == 0.25 and rows["ORD1"].FirstTime == 0 and rows["ORD1"].RTO == 1
    assert rows["ORD3"].IsCOD == 0 and rows["ORD3"].RTO == 0 and rows["ORD3"].FirstTime == 1
    assert rows["ORD1"].Device == "Unknown" and rows["ORD1"].CityTier == "Tier-1"


def test_schema_guard(spark):
    raw = _raw(spark, [{}]).drop("PriorReturns")
    with pytest.raises(C.MissingColumnsError):
        C.clean_orders(raw)


def test_cleaning_is_idempotent_on_clean_values(spark):
    raw = _raw(spark, [{"OrderID": f"ORD{i}", "CityTier": t} for i, t in enumerate(["T2", "tier3"])])
    once = C.clean_orders(raw)
    again = C.clean_orders(once.select(*[F.col(c).cast(RAW_SCHEMA[c].dataType) for c in RAW_SCHEMA.names]))
    cols = ["OrderID", "CityTier", "State", "OrderValue", "DiscountPct"]
    assert sorted(once.select(cols).collect()) == sorted(again.select(cols).collect())


def test_dedup_of_a_large_table_compares_only_rows_that_share_a_hash(spark):
    rows = [(i % 40, f"t{i % 40}" if i % 3 else None, float(i % 2)) for i in range(200)] + [(None, None, None)] * 2 + [(i, "once", 1.0) for i in range(100, 900)]
    raw = Scratch(spark, "dedup_rows").table(spark.createDataFrame(rows, "a int, b string, c double"), "rows")
    for most_keys in (1 << 21, 0):
        got = C.dedup(raw, plain_rows=10, most_keys=most_keys)
        assert sorted(map(str, got.collect())) == sorted(map(str, raw.distinct().collect()))
    scan_only = C.dedup(raw, plain_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in scan_only  # rows of their own are passed on, not shuffled
    assert C.dedup(raw).count() == raw.distinct().count()
