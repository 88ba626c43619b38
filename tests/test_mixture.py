"""Gaussian mixtures against a plain version."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from parcelwise.operators import lloyd as L
from parcelwise.operators import mixture as M
from parcelwise.operators import segment as SG

STARTS = [1, 2, 3]


def _frame(spark, x):
    rows = [(f"C{i:04d}", float(i % 2), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "CustomerID string, ReturnRate double, f array<double>") \
        .withColumn("features", array_to_vector("f"))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 3)) * (1, 2, 0.5), rng.normal(size=(100, 3)) + (3, 0, 1)])
    x[:, 2] = np.where(np.arange(250) < 150, 1.0, x[:, 2])  # a component without spread in a column
    x[20:40] = x[7]  # repeated rows
    frame = _frame(spark, x)
    return x, frame, L.fit(frame, [2, 3], STARTS)


@pytest.fixture(scope="module")
def fitted(points):
    return M.fit(points[1].repartition(5), {s: points[2][2, s] for s in STARTS})


def _plain_shares(x, weights, means, covariances):
    density = np.stack([
        w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c))
        for w, m, c in zip(weights, means, covariances)], axis=1)
    return density / density.sum(1, keepdims=True), np.log(density.sum(1)).mean()


def _plain_fit(x, centres):
    share = (((x[:, None] - centres) ** 2).sum(-1).argmin(1)[:, None] == np.arange(len(centres))).astype(float)
    before = -np.inf
    for _ in range(101):
        n = share.sum(0)
        means = share.T @ x / n[:, None]
        covariances = [((x - m).T * r) @ (x - m) / r.sum() + 1e-6 * np.eye(x.shape[1]) for m, r in zip(means, share.T)]
        model = n / n.sum(), means, covariances
        if before > -np.inf and abs(before - last) < M.TOLERANCE:
            return model, before
        last = before
        share, before = _plain_shares(x, *model)
    return model, before


def test_equals_the_plain_version(points, fitted):
    x, frame, groups = points
    for start in STARTS:
        model, likelihood = _plain_fit(x, groups[2, start].points)
        got = fitted[start]
        assert np.allclose(got.weights, model[0], atol=1e-7) and np.allclose(got.means, model[1], atol=1e-7)
        assert np.allclose(got.covariances, model[2], atol=1e-7)
        rows = frame.select("CustomerID", got.memberships(vector_to_array("features")).alias("p")).orderBy("CustomerID").collect()
        assert np.allclose([r["p"] for r in rows], _plain_shares(x, *model)[0], atol=1e-6)


def test_partitions_do_not_matter(points, fitted):
    again = M.fit(points[1].repartition(2), {s: points[2][2, s] for s in STARTS})
    for start, model in fitted.items():
        assert (again[start].means == model.means).all() and (again[start].covariances == model.covariances).all()
        assert again[start].likelihood == model.likelihood


def test_starts_share_their_scans(points, monkeypatch):
    passes = []
    real = M._pass
    monkeypatch.setattr(M, "_pass", lambda t, share, *rest: passes.append(len(share)) or real(t, share, *rest))
    together = M.fit(points[1], {s: points[2][3, s] for s in STARTS})
    alone = []
    for s in STARTS:
        begin = len(passes)
        M.fit(points[1], {s: points[2][3, s]})
        alone.append(len(passes) - begin)
    assert passes[0] == len(STARTS) and len(passes) - sum(alone) == max(alone)
    assert len(M.best(together).weights) == 3


def test_far_rows_have_whole_memberships(spark, fitted):
    far = spark.createDataFrame([([1e4, -1e4, 1e4],), ([-1e4, 0.0, 0.0],)], "x array<double>")
    for (p,) in far.select(fitted[1].memberships(F.col("x"))).collect():
        assert sum(p) == pytest.approx(1.0) and all(0 <= v <= 1 for v in p)


def test_riskier_component(points, spark):
    x = points[0]
    rate = F.when(F.substring("CustomerID", 2, 4).cast("int") < 150, 0.9).otherwise(0.1)
    got = SG.gmm_membership(points[1].withColumn("ReturnRate", rate), seeds=STARTS).collect()
    near = [r["p_risky"] for r in got if r["CustomerID"] < "C0150"]
    assert len(got) == len(x) and np.mean(near) > 0.9 > 0.1 > np.mean([r["p_risky"] for r in got if r["CustomerID"] >= "C0150"])


def test_few_and_no_rows(spark):
    same = _frame(spark, np.ones((6, 2)))
    assert [r["p_risky"] for r in SG.gmm_membership(same, seeds=[1, 2]).collect()] == [1.0] * 6
    assert SG.gmm_membership(same.limit(0), seeds=[1, 2]).collect() == []
