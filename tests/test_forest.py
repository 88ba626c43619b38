"""The forest against a plain version, and its independence of partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import forest as R
from test_boosting import CAT, NUM, SCHEMA, _matrix, _rows

TREES, DEPTH = 7, 5


def _plain_tree(x, y, times, tree, weights, depth):
    """All nodes of one tree as {(level, place): (feature, threshold) or share of label 1}."""
    m, out = math.isqrt(x.shape[1]), {}
    open_nodes = [(0, 0, times > 0)]
    while open_nodes:
        level, place, mine = open_nodes.pop()
        count = [int(times[mine & (y == c)].sum()) for c in (0, 1)]
        out[level, place] = count[1] * weights[1] / (count[0] * weights[0] + count[1] * weights[1])
        if level == depth or min(count) == 0:
            continue
        node, best = (1 << level) - 1 + place, None
        order = np.argsort(R._hashed(R.SEED + 1, tree, node, np.arange(x.shape[1])))
        for first in range(0, len(order), m):
            for j in order[first:first + m]:
                known = np.unique(x[mine, j])
                for t in (known[1:] + known[:-1]) / 2:
                    left = mine & (x[:, j] <= t)
                    low = [times[left & (y == c)].sum() for c in (0, 1)]
                    gain = R.gini_gain(low, count, weights)
                    if best is None or gain > best[0]:
                        best = (gain, j, t)
            if best:
                break
        if best:
            _, j, t = best
            out[level, place] = (j, t)
            open_nodes += [(level + 1, 2 * place, mine & (x[:, j] <= t)), (level + 1, 2 * place + 1, mine & (x[:, j] > t))]
    return out


def _plain_value(tree, row):
    level, place = 0, 0
    while isinstance(tree[level, place], tuple):
        j, t = tree[level, place]
        level, place = level + 1, 2 * place + int(row[j] > t)
    return tree[level, place]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _rows(200)
    frame = spark.createDataFrame(rows, SCHEMA)
    return rows, frame, R.fit_forest(frame.repartition(3), NUM, CAT, trees=TREES, depth=DEPTH)


def test_equals_the_plain_version(spark, fitted):
    rows, frame, model = fitted
    x, y = _matrix(rows), np.array([r[1] for r in rows])
    weights = [len(y) / (2 * (y == c).sum()) for c in (0, 1)]
    keys = {r[0]: r[1] for r in frame.select("OrderID", F.xxhash64("OrderID")).collect()}
    times = R.draws(np.array([keys[r[0]] for r in rows]), np.arange(TREES), R.SEED)
    trees = [_plain_tree(x, y, times[:, t], t, weights, DEPTH) for t in range(TREES)]
    expected = [np.mean([_plain_value(t, row) for t in trees]) for row in x]
    got = {r["OrderID"]: r["Risk"] for r in model.predict(frame, ["OrderID"]).collect()}
    assert np.allclose([got[r[0]] for r in rows], expected, atol=1e-12)


def test_partitions_do_not_matter(fitted):
    _, frame, model = fitted
    again = R.fit_forest(frame.repartition(7, "RTO", "b"), NUM, CAT, trees=TREES, depth=DEPTH)
    for name in ("column", "bound", "value", "gain"):
        assert (getattr(model, name) == getattr(again, name)).all()


def test_draws_are_poisson():
    times = R.draws(np.arange(20_000) * 7919, np.arange(5), 1)
    assert times.mean(axis=0) == pytest.approx(np.ones(5), abs=0.03)
    assert times.var(axis=0) == pytest.approx(np.ones(5), abs=0.06)
    assert abs(np.corrcoef(times.T) - np.eye(5)).max() < 0.03
    drawn = R.drawn_features(np.arange(3000), np.zeros(3000, int), np.zeros(3000, int), 9, 3, 1)
    assert all(len(set(d)) == 3 for d in drawn)
    assert np.bincount(drawn.ravel(), minlength=9) == pytest.approx(np.full(9, 1000), rel=0.12)


def test_save_load_and_importances(spark, fitted, tmp_path):
    rows, frame, model = fitted
    model.save(spark, f"file://{tmp_path}/model")
    loaded = R.Forest.load(spark, f"file://{tmp_path}/model")
    before, after = [sorted(m.predict(frame, ["OrderID", "RTO"]).collect()) for m in (model, loaded)]
    assert before == after and len(before) == len(rows)
    shares = dict(model.importances())
    assert set(shares) == {"a", "b", "c=x", "c=y", "c=z", "d=p", "d=q"} and sum(shares.values()) == pytest.approx(1)
    unseen = spark.createDataFrame([(1, 0, 0, None, None, "new", None)], SCHEMA)
    assert 0 <= model.predict(unseen, ["OrderID"]).first()["Risk"] <= 1


def test_small_batches_and_slices(spark, fitted, monkeypatch):
    """A feature's counts may go on in the next batch, and trees in the next slice."""
    _, frame, model = fitted
    monkeypatch.setattr(R, "SLICE", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        again = R.fit_forest(frame, NUM, CAT, trees=TREES, depth=DEPTH)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (model.bound == again.bound).all() and (model.value == again.value).all()


def test_one_class_no_rows_and_equal_rows(spark):
    one = spark.createDataFrame([(i, 1, 0, float(i), None, None, "p") for i in range(5)], SCHEMA)
    model = R.fit_forest(one, NUM, CAT, trees=3, depth=3)
    assert np.isinf(model.bound).all()
    empty = spark.createDataFrame([], SCHEMA)
    model = R.fit_forest(empty, NUM, CAT, trees=3, depth=3)
    assert model.predict(one, ["OrderID"]).first()["Risk"] == 0.5
    # all features constant: every one is tried, none splits
    same = spark.createDataFrame([(i, i % 2, 0, 1.0, 1.0, "x", "p") for i in range(40)], SCHEMA)
    model = R.fit_forest(same, NUM, CAT, trees=3, depth=3)
    assert np.isinf(model.bound).all() and all(v == 0.0 for _, v in model.importances())


def test_large_nodes_and_groups_grow_alike(fitted, monkeypatch):
    """Nodes of few rows are grown in groups, others in passes over all rows, in parts of bounded size."""
    _, frame, model = fitted
    widest, real = [], R._counts
    for rows, cells in ((0, 1 << 20), (60, 1 << 20), (0, 60)):
        passes = []
        monkeypatch.setattr(R, "_counts", lambda *a: passes.append(a[5].total) or real(*a))
        monkeypatch.setattr(R, "GROUP_ROWS", rows)
        monkeypatch.setattr(R, "PASS_CELLS", cells)
        again = R.fit_forest(frame.repartition(5), NUM, CAT, trees=TREES, depth=DEPTH)
        for name in ("column", "bound", "value", "gain"):
            assert (getattr(model, name) == getattr(again, name)).all()
        widest.append(max(passes))
    assert widest[2] < widest[0]


def test_deep_levels_take_no_pass_of_their_own(fitted, monkeypatch):
    """A table whose trees fit into groups is read once to grow them, whatever the depth."""
    _, frame, _ = fitted
    monkeypatch.setattr(R, "_counts", None)  # no pass over all rows
    assert np.isfinite(R.fit_forest(frame, NUM, CAT, trees=2, depth=6).bound).any()
