import numpy as np

from parcelwise.operators import describe as D


def test_histogram_last_bin_closed_like_numpy(spark):
    vals = [300, 301, 350, 599, 600, 600, 451, 452, 333, 444]
    df = spark.createDataFrame([(v,) for v in vals], "Score int")
    got = {r.bin: r.n for r in D.histogram(df, "Score", 40).collect()}
    want, _ = np.histogram(vals, bins=40)
    assert [got.get(i, 0) for i in range(40)] == want.tolist()


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "State string")
    r = D.mode_of(df, "State").first()
    assert r["mode"] == "a" and r["n"] == 2


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (0, 5.0, 2.0), (1, 5.0, None), (0, 5.0, 4.0)],
                               "RTO int, const double, x double")
    got = {r.feature: r.corr for r in D.corr_with_rto(df, ["const", "x"]).collect()}
    assert got["const"] is None
    xs, ys = np.array([1.0, 2.0, 4.0]), np.array([1, 0, 0])      # pairwise-complete rows
    assert abs(got["x"] - round(float(np.corrcoef(xs, ys)[0, 1]), 6)) < 1e-9


def test_value_quartiles_interpolated_first_band_closed(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([(v,) for v in vals], "OrderValue double")
    got = {r.OrderValue: r.ValueQuartile for r in D.with_value_quartile(df).collect()}
    # quartiles 2.75 / 4.5 / 6.25 (linear): 1,2 | 3,4 | 5,6 | 7,8 ; the minimum is included
    assert [got[v] for v in vals] == ["Cheapest 25%"] * 2 + ["Lower-mid"] * 2 + ["Upper-mid"] * 2 + ["Priciest 25%"] * 2


def test_rate_by_drops_null_and_small_levels(spark):
    rows = [("A", 1)] * 25 + [("A", 0)] * 25 + [("B", 1)] * 5 + [(None, 1)] * 30
    df = spark.createDataFrame(rows, "lvl string, RTO int")
    out = D.rate_by(df, "lvl", min_n=20).collect()
    assert [(r.level, r.n, r.return_rate) for r in out] == [("A", 50, 0.5)]
    assert out[0].overall_rate == round(60 / 85, 6) and out[0].vs_overall == "below"


def test_histogram_of_joined_scores_joins_once(spark, monkeypatch):
    """The histogram reads its rows twice (range, bins); the orders are joined to their scores once."""
    from parcelwise.plans import queries as Q
    orders = spark.createDataFrame([(f"O{i}", i) for i in range(50)], "OrderID string, v int")
    scores = spark.createDataFrame([(f"O{i}", 300 + 7 * i) for i in range(60)] + [("O3", None)], "OrderID string, Score int")
    joined = orders.join(scores, "OrderID")
    monkeypatch.setattr(Q, "_oof_scored", lambda spark, sf: joined)
    found = Q.QUERIES["hist_score_oof"](spark, "")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, D.histogram(joined, "Score", 40).collect()))
