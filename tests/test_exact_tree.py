"""Exact-threshold trees against a plain version; value ranges and partitions do not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.operators import exact_tree as T
from test_boosting import CAT, NUM, SCHEMA, _rows


def _sums(rows, measure):
    if measure == "gini":
        return sum(r[1] == 0 for r in rows), sum(r[1] == 1 for r in rows)
    return len(rows), sum(r[3] for r in rows)


def _value(sums, measure, w):
    if measure == "gini":
        x, y = sums[0] * w[0], sums[1] * w[1]
        return (x * x + y * y) / (x + y)
    return sums[1] * sums[1] / sums[0]


def _plain(rows, num, cat, measure, w, depth, fill):
    """Nested (test, left, right) or the leaf's sums; every cut of every column tried in order."""
    whole = _sums(rows, measure)
    if depth == 0 or measure == "gini" and 0 in whole:
        return whole
    best = None
    tests = []
    for j in num:
        known = sorted({fill if r[j] is None else r[j] for r in rows})
        tests += [(j, (a + b) / 2) for a, b in zip(known, known[1:])]
    for j in cat:
        tests += [(j, v) for v in sorted({r[j] for r in rows if r[j] is not None})]
    for test in tests:
        right = [r for r in rows if _goes(r, test, fill)]
        left = [r for r in rows if not _goes(r, test, fill)]
        if left and right:
            score = _value(_sums(left, measure), measure, w) + _value(_sums(right, measure), measure, w)
            if best is None or score > best[0] + 1e-9:
                best = (score, test, left, right)
    if best is None:
        return whole
    return (best[1], *[_plain(x, num, cat, measure, w, depth - 1, fill) for x in best[2:]])


def _goes(r, test, fill):
    j, bound = test
    if isinstance(bound, str):
        return r[j] == bound
    return (fill if r[j] is None else r[j]) > bound


def _leaf(tree, r, fill):
    while len(tree) == 3:
        tree = tree[2] if _goes(r, tree[0], fill) else tree[1]
    return tree


@pytest.mark.parametrize("range_rows", [T.RANGE_ROWS, 60])
def test_gini_tree(spark, range_rows):
    rows = _rows(300, seed=8)
    fill = float(np.median([r[4] for r in rows if r[4] is not None]))
    n0, n1 = _sums(rows, "gini")
    w = (300 / (2 * n0), 300 / (2 * n1))
    plain = _plain(rows, [3, 4], [5, 6], "gini", w, 4, fill)
    for frame in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)):
        tree = T.grow(frame, NUM, CAT, "RTO", depth=4, range_rows=range_rows)
        mine = {r["OrderID"]: r["risk"] for r in frame.select("OrderID", T.risk(tree).alias("risk")).collect()}
        for r in rows:
            a, b = _leaf(plain, r, fill)
            assert mine[r[0]] == pytest.approx(b * w[1] / (a * w[0] + b * w[1]), abs=1e-12)
        assert len(tree.rules()) == len(tree.splits)


@pytest.mark.parametrize("name", ["Decision Tree", "Logistic Regression", "Gradient Boosting"])
def test_models_are_saved_and_loaded(spark, tmp_path, monkeypatch, name):
    from parcelwise.operators import models as ML
    monkeypatch.setattr(ML, "NUM_FEATS", NUM)
    monkeypatch.setattr(ML, "CAT_FEATS", CAT)
    frame = spark.createDataFrame(_rows(120, seed=4), SCHEMA)
    model, (before,) = ML.fit_predict(frame, [frame], name)
    path = f"file://{tmp_path}/{name.replace(' ', '_')}"
    ML.save_model(spark, model, path)
    after = ML.predict(ML.load_model(spark, path), frame, extra=["fold"])
    assert after.columns == ["OrderID", "RTO", "fold", "Risk", "prediction"]
    want = {r["OrderID"]: r["Risk"] for r in before.collect()}
    assert all(r["Risk"] == pytest.approx(want[r["OrderID"]], abs=1e-12) for r in after.collect())


def test_regression_tree(spark):
    rows = _rows(250, seed=9)
    fill = float(np.median([r[4] for r in rows if r[4] is not None]))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tree = T.grow(frame, ["b"], CAT, "a", "squares", depth=3)
    plain = _plain(rows, [4], [5, 6], "squares", None, 3, fill)
    for r in frame.select("OrderID", T.mean(tree).alias("p")).collect():
        n, total = _leaf(plain, rows[r["OrderID"]], fill)
        assert r["p"] == pytest.approx(total / n, abs=1e-9)


def test_no_rows_one_class_and_nothing_to_cut(spark):
    empty = T.grow(spark.createDataFrame([], SCHEMA), NUM, CAT, "RTO")
    assert not empty.splits
    rows = [(i, i % 2, 0, 1.0, None, "x", None) for i in range(6)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert not T.grow(frame, NUM, CAT, "RTO").splits
    assert frame.select(T.risk(T.grow(frame, NUM, CAT, "RTO")).alias("r")).first()["r"] == 0.5
    one = T.grow(frame.where(F.col("RTO") == 1), NUM, CAT, "RTO")
    assert not one.splits and frame.select(T.risk(one).alias("r")).first()["r"] == 1.0


def test_tasks_hand_on_counts_and_not_rows_times_columns(spark):
    """3,000 rows in one task come out as their distinct (node, column, value), with exact sums."""
    from decimal import Decimal
    y = [Decimal("900000000000000.0001"), Decimal("-1.5000"), Decimal("0.0003"), None]
    rows = [(i, float("nan") if i % 5 == 4 else float(i % 5), None if i % 7 == 0 else i % 3 + 0.5, "pq"[i % 2] if i % 11 else None, y[i % 4])
            for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, a double, b double, c string, y decimal(20,4)").coalesce(1)
    tree = T.grow(frame, ["a", "b"], ["c"], "y", "squares", depth=2)
    known = [r for r in rows if r[4] is not None]
    assert tree.leaves[1] == (len(known), sum(r[4] for r in known))
    for parent in tree.splits:
        assert [sum(x) for x in zip(tree.leaves[2 * parent], tree.leaves[2 * parent + 1])] == list(tree.leaves[parent])
    reached = {r["leaf"]: (r["n"], r["s"]) for r in frame.where("y IS NOT NULL").groupBy(tree.leaf().alias("leaf"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()}
    assert reached == {k: v for k, v in tree.leaves.items() if k not in tree.splits}
    enc = tree.encoding
    stats = [c.alias(f"s{i}") for i, c in enumerate(T._stats("y", "squares"))]
    packed = T._packed(frame.where("y IS NOT NULL").select(*enc.numbers(), *enc.codes(), *stats))
    assert [r["n"] for r in packed.collect()] == [len(known)]
    cells = T._cells(packed, T.Tree(enc), 0, len(stats)).collect()
    assert len(cells) == 5 + 3 + 3
    for col in range(3):
        assert sum(r["s2"] * T.PART + r["s1"] for r in cells if r["col"] == col) == 10_000 * sum(r[4] for r in known)
