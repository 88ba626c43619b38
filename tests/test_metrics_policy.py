import itertools
import random

from pyspark.sql import functions as F

from parcelwise.operators import metrics as M
from parcelwise.operators import policy as P


def _scores(n=300, seed=3, ties=True):
    rnd = random.Random(seed)
    return [(i, int(rnd.random() < 0.4), round(rnd.random(), 1 if ties else 6)) for i in range(n)]


def _brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    tot = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p, q in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_matches_pairs_with_ties(spark):
    rows = _scores()
    df = spark.createDataFrame(rows, "id int, y int, s double")
    got = M.auc(df, "y", "s").first().auc
    assert abs(got - round(_brute_auc(rows), 6)) < 1e-9
    flipped = M.auc(df.withColumn("s", 1 - F.col("s")), "y", "s").first().auc
    assert abs(got + flipped - 1.0) < 2e-6


def test_prefix_sums_many_ranges(spark):
    rows = [(i, i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, m int")
    got = {r.k: r.m_before for r in M.prefix_sums(df, "k", ["m"], range_rows=64).collect()}
    run = 0
    for k, m in rows:
        assert got[k] == run
        run += m


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.3)], "id int, y int, s double")
    assert M.auc(df, "y", "s").first().auc is None


def test_prf_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "RTO int, Pred int")
    r = M.threshold_metrics(df).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0


def _scored(spark):
    rnd = random.Random(5)
    rows = [(f"O{i}", rnd.randint(300, 900), int(rnd.random() < 0.3), float(rnd.randint(100, 5000)))
            for i in range(400)]
    return spark.createDataFrame(rows, "OrderID string, Score int, RTO int, OrderValue double")


def test_tiers_partition_and_guard(spark):
    s = _scored(spark)
    summ = P.summary(s).collect()
    assert sum(r.orders for r in summ) == 400 and len(summ) == 3
    g = {r.Tier: r.orders for r in P.summary(s, P.Policy(low=720, high=700)).collect()}
    n730 = s.where("Score >= 730").count()
    assert g["Free COD"] == n730


def test_empty_tier_kept(spark):
    s = _scored(spark).where("Score >= 600")
    r = {x.Tier: x for x in P.summary(s).collect()}
    assert r["Prepaid-only"].orders == 0 and r["Prepaid-only"].return_rate is None
    m = P.money(s).first()
    assert m.saved == 0.0 and m.lost_margin == 0.0


def test_sweep_equals_direct_money(spark):
    s = _scored(spark)
    grid = P.policy_grid(spark, lows=[500, 580], highs=[720], fees=[50], costs=[250])
    sw = {(r.low, r.high): r for r in P.sweep(s, grid).collect()}
    for low in (500, 580):
        d = P.money(s, P.Policy(low=low, high=720)).first()
        w = sw[(low, 720)]
        for c in ("baseline_loss", "saved", "lost_margin", "fee_income", "net"):
            assert abs(getattr(d, c) - getattr(w, c)) < 1e-6, c


def test_unscored_orders_are_in_no_figure(spark):
    s = _scored(spark)
    more = s.unionByName(spark.createDataFrame([("X1", None, 1, 9e9), ("X2", None, 0, 1.0)], s.schema))
    assert P.assign_tier(more).where("Score IS NULL AND Tier IS NOT NULL").count() == 0
    assert P.summary(more).collect() == P.summary(s).collect()
    assert P.money(more).first() == P.money(s).first()
    grid = P.policy_grid(spark, lows=[580, 700], highs=[600, 720], fees=[50], costs=[250])
    key = lambda r: (r.low, r.high)
    assert sorted(P.sweep(more, grid).collect(), key=key) == sorted(P.sweep(s, grid).collect(), key=key)
    assert sorted(P.rate_grid(more, grid).collect(), key=key) == sorted(P.rate_grid(s, grid).collect(), key=key)
    guarded = {key(r): r for r in P.sweep(s, grid).collect()}[(700, 600)]
    assert abs(guarded.net - P.money(s, P.Policy(low=700, high=600)).first().net) < 1e-6


def test_exact_quantiles_and_large_amounts(spark):
    import numpy as np
    from parcelwise.operators import describe as D
    from parcelwise.operators import regress as RG
    rng = np.random.default_rng(4)
    v = 1e9 + rng.normal(size=501).round(3)
    y = (rng.random(501) < 0.4).astype(int)
    p = v + rng.normal(scale=0.5, size=501)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(v, y, p)], "OrderValue double, RTO int, p double")
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    assert np.allclose(M.exact_quantiles(df, "OrderValue", shares), np.quantile(v, shares), rtol=0, atol=1e-6)
    assert np.isclose(D.corr_with_rto(df, ["OrderValue"]).first()["corr"], np.corrcoef(v, y)[0, 1], atol=2e-6)
    r2 = 1 - ((v - p) ** 2).sum() / ((v - v.mean()) ** 2).sum()
    assert np.isclose(RG.r2_mae(df, "OrderValue", "p").first()["r2"], r2, atol=2e-6)
