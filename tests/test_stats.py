from pyspark.sql import functions as F

from parcelwise.operators import stats as S


def _table(spark, counts):
    """counts: {level: (o0, o1)} -> one row per order."""
    rows = []
    for lvl, (o0, o1) in counts.items():
        rows += [(lvl, 0)] * o0 + [(lvl, 1)] * o1
    return spark.createDataFrame(rows, "clue string, RTO int")


def test_yates_on_2x2(spark):
    df = _table(spark, {"a": (30, 10), "b": (15, 25)})
    r = S.chi_square(df, ["clue"]).first()
    assert abs(r.chi2 - 9.955556) < 1e-6 and r.dof == 1


def test_no_correction_on_3x2_and_null_level_dropped(spark):
    df = _table(spark, {"a": (30, 10), "b": (15, 25), "c": (20, 20)})
    df = df.unionByName(spark.createDataFrame([(None, 1)] * 50, "clue string, RTO int"))
    r = S.chi_square(df, ["clue"], with_pvalue=True).first()
    # sum over cells of (O-E)^2/E for [[30,10],[15,25],[20,20]]
    import numpy as np
    o = np.array([[30, 10], [15, 25], [20, 20]], float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert abs(r.chi2 - ((o - e) ** 2 / e).sum()) < 1e-6
    assert r.dof == 2 and r.n == 120 and r.n_levels == 3
    assert abs(r.p_value - np.exp(-r.chi2 / 2)) < 1e-6  # chi2 with 2 dof: p = exp(-x/2), 6 decimals
    v = np.sqrt(r.chi2 / 120 / 1)
    assert abs(r.cramers_v - v) < 1e-6


def test_constant_target_gives_zero(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "clue string, RTO int")
    r = S.chi_square(df, ["clue"]).first()
    assert r.chi2 == 0.0 and r.dof == 0
