from pyspark.sql import functions as F

from parcelwise.functions import exprs as X
from parcelwise.functions.pvalue import chi2_sf


def _one(spark, values, expr, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_parse_currency(spark):
    vals = ["Rs 1,299", "INR 1,299", "Rs.1,299", "1,299", "Rs.999", "", None, "abc", "-50", "1e3", "12.50"]
    got = _one(spark, vals, X.parse_currency)
    assert got == [1299.0, 1299.0, 1299.0, 1299.0, 999.0, None, None, None, -50.0, None, 12.5]


def test_parse_currency_parity_keeps_dot_defect(spark):
    got = _one(spark, ["Rs.1,299", "-50", "1e3"], lambda c: X.parse_currency(c, parity=True))
    assert got == [0.1299, 50.0, 13.0]


def test_parse_percent(spark):
    got = _one(spark, ["20", "20%", "100", "101", "999%", "-5", "x", None], X.parse_percent)
    assert got == [20.0, 20.0, 100.0, 101.0, 999.0, -5.0, None, None]


def test_tier_label(spark):
    spellings = [f"{p}{t}" for t in "123" for p in ("Tier-", "Tier ", "tier", "T", "TIER-")]
    got = _one(spark, spellings + ["Tier-4", None], X.tier_label)
    assert got[:15] == [f"Tier-{t}" for t in "123" for _ in range(5)]
    assert got[15:] == [None, None]


def test_title_case_like_python(spark):
    vals = ["  karnataka ", "TAMIL NADU", "o'neil-smith", "x3rd", None]
    got = _one(spark, vals, X.clean_state)
    assert got == ["Karnataka", "Tamil Nadu", "O'Neil-Smith", "X3Rd", "Unknown"]
    assert got[:4] == [v.strip().title() for v in vals[:4]]


def test_cut_edges_left_open(spark):
    vals = [-1.0, 0.0, 10.0, 10.5, 25.0, 40.0, 40.1, 100.0, 101.0, None]
    got = _one(spark, vals, lambda c: X.cut(c, X.DISCOUNT_EDGES, X.DISCOUNT_LABELS), "double")
    assert got == [None, "0-10%", "0-10%", "11-25%", "11-25%", "26-40%", "40%+", "40%+", None, None]


def test_score_half_even(spark):
    # p = 0.5025 -> 900 - 301.5 = 598.5 -> 598 (half to even); p = 0.5075 -> 595.5 -> 596
    got = _one(spark, [0.5025, 0.5075, 0.0, 1.0], X.score_from_risk, "double")
    assert got == [598, 596, 900, 300]


def test_hash_uniform_matches_md5(spark):
    import hashlib
    got = _one(spark, ["12"], lambda c: X.hash_uniform(c, "tier"))[0]
    want = int(hashlib.md5(b"12-tier").hexdigest()[:8], 16) / 2 ** 32
    assert abs(got - want) < 1e-15


def test_chi2_sf_critical_values():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(chi2_sf(11.070497693516351, 5) - 0.05) < 1e-9
    assert abs(chi2_sf(30.577914166892498, 15) - 0.01) < 1e-9
    assert chi2_sf(0.0, 3) == 1.0 and chi2_sf(5.0, 0) == 1.0


def test_title_case_takes_the_quick_way_where_it_is_the_same(spark):
    values = ["UNITED KINGDOM", "a  bC d", "x", "", " y", "o'neil-smith", "new\tdelhi", "goa\n", "r2d2 x", "ÉCOLE abc", "ijMUIDEN", None]
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", X.title_case("v").alias("t"))
    assert "initcap" in df._jdf.queryExecution().analyzed().toString()
    got = {r["i"]: r["t"] for r in df.collect()}
    ascii_only = {i: v.title() if v is not None else None for i, v in rows if v is None or v.isascii()}
    assert {i: got[i] for i in ascii_only} == ascii_only
