"""Linear models from sums of products against direct NumPy solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import gram as G
from test_boosting import CAT, NUM, SCHEMA, _matrix, _rows


def _scaled(x, k):
    """The first ``k`` columns centred and scaled, the others as they are."""
    out = x.copy()
    out[:, :k] = (x[:, :k] - x[:, :k].mean(0)) / x[:, :k].std(0)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = _rows(500, seed=3)
    return rows, _matrix(rows), np.array([r[1] for r in rows]), spark.createDataFrame(rows, SCHEMA).repartition(4)


def _predicted(frame, column):
    return np.array([r["p"] for r in frame.select("OrderID", column.alias("p")).orderBy("OrderID").collect()])


@pytest.mark.parametrize("kind", ["linear", "ridge", "lasso"])
def test_regression(data, kind):
    rows, x, _, frame = data
    y = x[:, 0] * 30 + x[:, 2] * 40 + np.random.default_rng(1).normal(size=len(x))
    frame = frame.join(frame.sparkSession.createDataFrame([(r[0], float(v)) for r, v in zip(rows, y)], "OrderID long, y double"), "OrderID")
    inputs = G.scaled_inputs(frame, NUM, CAT)
    (matrix,) = G.grams(frame, inputs, "y", F.lit(0), 1)
    mine = _predicted(frame, G.solve(inputs, matrix, kind, 2.0).column())
    z = _scaled(x, 2)
    zc, yc = z - z.mean(0), y - y.mean()
    if kind == "linear":
        w = np.linalg.lstsq(zc, yc, rcond=None)[0]
    elif kind == "ridge":
        w = np.linalg.solve(zc.T @ zc + 2.0 * np.eye(z.shape[1]), zc.T @ yc)
    else:
        w = np.zeros(z.shape[1])
        for _ in range(5000):  # proximal gradient, another way to the same minimum
            w = w - zc.T @ (zc @ w - yc) / np.linalg.norm(zc, 2) ** 2
            w = np.sign(w) * np.maximum(np.abs(w) - 2.0 * len(y) / np.linalg.norm(zc, 2) ** 2, 0)
    assert np.allclose(mine, y.mean() + zc @ w, atol=1e-5)


def test_folds_by_subtraction(data):
    _, _, _, frame = data
    inputs = G.scaled_inputs(frame, NUM, CAT)
    each = G.grams(frame, inputs, "RTO", F.col("fold"), 5)
    (rest,) = G.grams(frame.where("fold <> 2"), inputs, "RTO", F.lit(0), 1)
    assert np.allclose(each.sum(axis=0) - each[2], rest)


def _newton(x, y, w, penalty):
    z = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        h = z.T @ (z * (w * p * (1 - p))[:, None]) + np.diag(np.r_[0, penalty])
        b -= np.linalg.solve(h, z.T @ (w * (p - y)) + np.r_[0, penalty] * b)
    return b


def test_logistic_all_models_in_one_fit(data):
    rows, x, y, frame = data
    fold = np.array([r[2] for r in rows])
    members = [F.col("fold") != 1, F.lit(True)]
    for model, train in zip(G.logistic(frame, members, NUM, CAT), (fold != 1, fold >= 0)):
        mean, sd = x[train, :2].mean(0), x[train, :2].std(0)
        z = x.copy()
        z[:, :2] = (x[:, :2] - mean) / sd
        n1 = y[train].sum()
        w = np.where(y == 1, train.sum() / (2 * n1), train.sum() / (2 * (train.sum() - n1)))
        b = _newton(z[train], y[train], w[train], np.ones(z.shape[1]))
        raw = np.concatenate([[b[0] - (b[1:3] * mean / sd).sum()], b[1:3] / sd, b[3:]])
        assert list(model.coefficients().values()) == pytest.approx(list(raw), abs=1e-8)
        assert np.allclose(_predicted(frame, model.risk()), 1 / (1 + np.exp(-(b[0] + z @ b[1:]))), atol=1e-8)


def test_logistic_unscaled_and_unweighted(data):
    _, x, y, frame = data
    (model,) = G.logistic(frame, [F.lit(True)], NUM, CAT, balanced=False, scale=False)
    b = _newton(x, y, np.ones(len(y)), np.ones(x.shape[1]))
    assert list(model.coefficients().values()) == pytest.approx(list(b), abs=1e-7)


def test_one_class_no_rows_and_unseen_levels(spark):
    one = spark.createDataFrame([(i, 1, 0, float(i), None, "x", None) for i in range(5)], SCHEMA)
    (model,) = G.logistic(one, [F.lit(True)], NUM, CAT)
    assert all(r["p"] > 0.99 for r in one.select(model.risk().alias("p")).collect())
    (model,) = G.logistic(one.where("RTO = 0"), [F.lit(True)], NUM, CAT)
    assert one.select(model.risk().alias("p")).first()["p"] == 0.5
    rows = spark.createDataFrame(_rows(60), SCHEMA)
    (model,) = G.logistic(rows, [F.lit(True)], NUM, CAT)
    unseen = spark.createDataFrame([(1, 0, 0, None, None, "new", None)], SCHEMA)
    assert 0 < unseen.select(model.risk().alias("p")).first()["p"] < 1


def test_levels_are_looked_up_by_place(spark):
    """No map of levels per model; a NULL or unseen level weighs nothing."""
    rows = spark.createDataFrame(_rows(80, seed=6), SCHEMA)
    inputs = G.scaled_inputs(rows, NUM, CAT)
    model = G.Linear(inputs, np.arange(1.0, inputs.size + 1))
    odd = spark.createDataFrame([(1, 0, 0, 0.5, 1.0, "new", None)], SCHEMA)
    scored = odd.select(model.column().alias("p"))
    z = (np.array([0.5, 1.0]) - inputs.mean) / inputs.sd
    assert scored.first()["p"] == pytest.approx(1.0 + z @ [2.0, 3.0], abs=1e-12)
    at = 3
    for c, known in zip(CAT, inputs.encoding.levels):
        for i, level in enumerate(known):
            one = odd.withColumn(c, F.lit(level)).select(model.column().alias("p")).first()["p"]
            assert one == pytest.approx(1.0 + z @ [2.0, 3.0] + at + i + 1, abs=1e-12)
        at += len(known)
    plan = rows.select(model.column().alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" in plan and "element_at" not in plan
