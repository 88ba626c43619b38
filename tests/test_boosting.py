"""The booster against a plain NumPy version, and its independence of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import boosting as B
from parcelwise.operators.encoding import Encoding

NUM, CAT = ["a", "b"], ["c", "d"]
SCHEMA = "OrderID long, RTO int, fold int, a double, b double, c string, d string"


def _rows(n, seed=5, nulls=True):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        a, b = float(rng.integers(0, 40)), round(float(rng.normal()), 2)
        c, d = str(rng.choice(["x", "y", "z"])), str(rng.choice(["p", "q"]))
        risk = 1 / (1 + np.exp(-(0.1 * (a - 20) + b * (c == "y") - (d == "q"))))
        if nulls and i % 17 == 0:
            b, c = None, None
        out.append((i, int(rng.random() < risk), i % 5, a, b, c, d))
    return out


def _matrix(rows):
    """Numbers (missing: median) and one column per level, as the plain version takes them."""
    filled = np.median([r[4] for r in rows if r[4] is not None])
    return np.array([[r[3], filled if r[4] is None else r[4], *[float(r[5] == v) for v in "xyz"],
                      *[float(r[6] == v) for v in "pq"]] for r in rows])


def _plain_tree(x, resid, hess, depth):
    """A nested (column, threshold, left, right) or a leaf value: all midpoints tried."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            known = np.unique(x[:, j])
            for t in (known[1:] + known[:-1]) / 2:
                left = x[:, j] <= t
                n, m = left.sum(), (~left).sum()
                gain = (resid[left].mean() - resid[~left].mean()) ** 2 * n * m / (n + m)
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, t)
    if best is None:
        return resid.sum() / hess.sum() if hess.sum() > 1e-150 else 0.0
    _, j, t = best
    left = x[:, j] <= t
    return (j, t, _plain_tree(x[left], resid[left], hess[left], depth - 1),
            _plain_tree(x[~left], resid[~left], hess[~left], depth - 1))


def _plain_value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def _plain(x, y, train, rounds, depth=3):
    share = y[train].mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _plain_tree(x[train], (y - p)[train], (p * (1 - p))[train], depth)
        margin += 0.1 * np.array([_plain_value(tree, row) for row in x])
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _rows(400)
    members = [F.col("fold") != k for k in range(2)] + [F.lit(True)]
    frame = spark.createDataFrame(rows, SCHEMA)
    return rows, frame, members, B.fit_boosters(frame.repartition(3), members, NUM, CAT, rounds=12)


def test_equals_the_plain_version(fitted):
    rows, _, _, (_, out) = fitted
    x, y = _matrix(rows), np.array([r[1] for r in rows])
    fold = np.array([r[2] for r in rows])
    risks = {r["OrderID"]: r["risks"] for r in out.collect()}
    for m, train in enumerate((fold != 0, fold != 1, fold >= 0)):
        mine = np.array([risks[r[0]][m] for r in rows])
        assert np.allclose(mine, _plain(x, y, train, 12), atol=1e-6)


def test_partitions_do_not_matter(fitted):
    _, frame, members, (models, _) = fitted
    again, _ = B.fit_boosters(frame.repartition(7, "RTO", "b"), members, NUM, CAT, rounds=12)
    for a, b in zip(models, again):
        for name in ("column", "bound", "value", "gain"):
            assert (getattr(a, name) == getattr(b, name)).all()


def test_predict_save_and_load(spark, fitted, tmp_path):
    rows, frame, _, (models, out) = fitted
    path = f"file://{tmp_path}/model"
    models[2].save(spark, path)
    loaded = B.Booster.load(spark, path)
    risks = {r["OrderID"]: r["risks"][2] for r in out.collect()}
    for r in loaded.predict(frame, ["OrderID", "RTO"]).collect():
        assert r["Risk"] == pytest.approx(risks[r["OrderID"]], abs=1e-12)
        assert r["prediction"] == float(r["Risk"] >= 0.5)
    unseen = spark.createDataFrame([(1, 0, 0, None, None, "new", None)], SCHEMA)
    assert 0 < loaded.predict(unseen, ["OrderID"]).first()["Risk"] < 1
    shares = dict(models[2].importances())
    assert set(shares) == {"a", "b", "c=x", "c=y", "c=z", "d=p", "d=q"} and sum(shares.values()) == pytest.approx(1)
    assert max(shares, key=shares.get) == "a"


def test_bins_of_many_values(spark):
    """More values than bins: parts of equal row counts, split at values of the rows."""
    rows = [(i, i % 2, 0, float(i), 0.0, "x", "p") for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    enc = Encoding.fit(frame, NUM, CAT)
    bounds, _ = B.bin_bounds(frame, enc, 10)
    assert [len(b) for b in bounds] == [9, 0]
    assert np.diff(np.concatenate([[-1], bounds[0], [999]])).tolist() == [100.0] * 10


def test_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(i, 1, 0, float(i), None, None, "p") for i in range(5)], SCHEMA)
    (model,), out = B.fit_boosters(one, [F.lit(True)], NUM, CAT, rounds=2)
    assert all(r["risks"][0] > 0.99 for r in out.collect())
    empty = spark.createDataFrame([], SCHEMA)
    (model,), out = B.fit_boosters(empty, [F.lit(True)], NUM, CAT, rounds=2)
    assert out.count() == 0
    assert model.predict(one, ["OrderID"]).first()["Risk"] == pytest.approx(0.5)


def test_few_files_keep_all_cores_busy(spark, fitted, monkeypatch):
    """A pass over a table that came in one file has a task per core, and shuffles a row per model and task."""
    _, frame, members, (models, _) = fitted
    tasks, real = [], B._histogram
    monkeypatch.setattr(B, "_histogram", lambda state, *a: tasks.append(state.rdd.getNumPartitions()) or real(state, *a))
    again, _ = B.fit_boosters(frame.coalesce(1), members, NUM, CAT, rounds=1)
    assert set(tasks) == {spark.sparkContext.defaultParallelism}
    assert (again[0].bound[0] == models[0].bound[0]).all()


def test_place_of_equals_walk():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 9, (4, 500)).astype(np.int16)
    column, bound = rng.integers(0, 4, 1023), rng.integers(0, 9, 1023).astype(float)
    bound[rng.random(1023) < 0.2] = 1 << 20
    for levels in (0, 1, 3, 10):
        assert (B.place_of(bins, column, bound, 2, levels) == B.walk(bins.T.astype(int), column, bound, 2, levels)).all()


def test_rows_without_a_label_are_scored_and_not_learnt_from(spark, fitted):
    rows, _, members, (models, _) = fitted
    more = rows + [(1000 + i, None, 0, 99.0, 9.0, "x", "q") for i in range(30)]
    again, out = B.fit_boosters(spark.createDataFrame(more, SCHEMA), members, NUM, CAT, rounds=12)
    assert all((a.bound == b.bound).all() and (a.value == b.value).all() for a, b in zip(again, models))
    new = out.where("OrderID >= 1000").collect()
    assert len(new) == 30 and all(r["y"] is None and 0 < r["risks"][0] < 1 for r in new)
