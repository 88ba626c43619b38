import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import LogisticRegression

from conftest import SF001


def _frame(spark, x, y, w=None):
    cols = [f"x{j}" for j in range(x.shape[1])]
    rows = [tuple(float(v) for v in x[i]) + (float(y[i]), float(1.0 if w is None else w[i]))
            for i in range(len(y))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", y double, w double")
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df)


def test_ridge_mapping_matches_closed_form(spark):
    """sklearn Ridge(alpha) <=> Spark regParam = alpha * sd(y) / n, standardization off."""
    rng = np.random.default_rng(1)
    n, alpha = 200, 50.0
    x = rng.normal(size=(n, 3))
    y = x @ np.array([3.0, -2.0, 0.5]) + 7 + rng.normal(scale=2.0, size=n)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    sd = y.std(ddof=1)
    m = LinearRegression(featuresCol="features", labelCol="y", regParam=alpha * sd / n, elasticNetParam=0.0,
                         standardization=False, solver="l-bfgs", maxIter=1000, tol=1e-12).fit(_frame(spark, x, y))
    assert np.allclose(m.coefficients.toArray(), beta, atol=1e-6)


def test_balanced_logistic_mapping_matches_newton(spark):
    """sklearn LogisticRegression(C=1, class_weight='balanced') <=> regParam = 1 / n."""
    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.array([1.5, -1.0]) - 1.0)))).astype(float)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    # Newton on 0.5*|b|^2 + sum_i w_i * logloss_i (intercept unpenalised)
    X = np.hstack([x, np.ones((n, 1))])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        g = X.T @ (w * (p - y)) + np.r_[b[:2], 0]
        H = X.T @ (X * (w * p * (1 - p))[:, None]) + np.diag([1.0, 1.0, 0.0])
        b -= np.linalg.solve(H, g)
    m = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / n,
                           elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12).fit(_frame(spark, x, y, w))
    assert np.allclose(m.coefficients.toArray(), b[:2], atol=1e-4)
    assert abs(m.intercept - b[2]) < 1e-4


def test_pca_ratios_and_kmeans_blobs(spark):
    from parcelwise.operators import segment as SG
    rng = np.random.default_rng(3)
    a = rng.normal(size=(150, 5)) + 6
    b = rng.normal(size=(150, 5)) - 6
    x = np.vstack([a, b])
    x = (x - x.mean(0)) / x.std(0)
    rows = [(f"C{i}", float(i % 2), x[i].tolist()) for i in range(300)]
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame(rows, "CustomerID string, ReturnRate double, f array<double>") \
        .withColumn("features", array_to_vector("f"))
    model, _ = SG.kmeans_best(df, 2, [1, 2, 3])
    lab = [r.prediction for r in model.transform(df).orderBy("CustomerID").select("prediction").collect()]
    ids = [f"C{i}" for i in range(300)]
    truth = dict(zip(ids, [0] * 150 + [1] * 150))
    pairs = sorted(zip(sorted(ids), lab))
    groups = {}
    for cid, p in pairs:
        groups.setdefault(p, set()).add(truth[cid])
    assert all(len(v) == 1 for v in groups.values()) and len(groups) == 2
    _, ratios = SG.pca_coords(df, k=3)
    ev = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(ratios, (ev / ev.sum())[:3], atol=1e-6)


def test_oof_each_order_scored_once_by_other_folds(spark):
    from parcelwise.operators import models as ML
    from parcelwise.plans import data
    cod = data.cod(spark, SF001)
    oof = ML.oof_scores(cod, name="Logistic Regression", n_folds=3).toPandas()
    assert len(oof) == cod.count() and oof.OrderID.is_unique
    assert oof.Score.between(300, 900).all() and set(oof.fold) == {0, 1, 2}


def test_knn_votes_with_every_labelled_row(spark, monkeypatch):
    """However many training rows there are, none is left out of the vote."""
    from parcelwise.operators import models as ML
    monkeypatch.setattr(ML, "KNN_FIT_ROWS", 100, raising=False)  # the limit that the vote had
    rng = np.random.default_rng(7)
    rows = [(f"O{i}", float(v), 10.0, 0.0, 0.0, 1.0, 12.0, 1.0, *["a"] * 5, int(rng.random() < 0.4))
            for i, v in enumerate(rng.permutation(400))]
    schema = ", ".join(["OrderID string", *[f"{c} double" for c in ML.NUM_FEATS], *[f"{c} string" for c in ML.CAT_FEATS], "RTO int"])
    train = spark.createDataFrame(rows, schema)
    test = train.where("OrderValue > 50 and OrderValue < 350 and OrderValue % 7 = 0")
    _, (p,) = ML.fit_predict(train, [test], "KNN")
    got = {r.OrderID: r.Risk for r in p.collect()}
    label = {r[1]: r[-1] for r in rows}
    value = {r[0]: r[1] for r in rows}
    assert len(got) > 30
    for order, risk in got.items():  # 12 rows on either side and the row itself
        assert abs(risk - np.mean([label[value[order] + k] for k in range(-12, 13)])) < 1e-12


def test_rule_support_falls_as_combos_grow(spark):
    from parcelwise.operators import rules as RU
    from parcelwise.plans import data
    r = {x.combo: x.support for x in RU.rules_cube(data.cod(spark, SF001), min_support=0.0, min_lift=0.0).collect()}
    for combo, sup in r.items():
        items = combo.split(" + ")
        if len(items) > 2:
            for drop in range(len(items)):
                sub = " + ".join(items[:drop] + items[drop + 1:])
                assert r[sub] >= sup - 1e-12
