"""Groups and silhouettes against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from parcelwise.operators import lloyd as L
from parcelwise.operators import mixture as X
from parcelwise.operators import segment as SG
from parcelwise.operators import silhouette as S

KS, STARTS = [2, 3, 5], [1, 2, 3]


def _frame(spark, x):
    rows = [(f"C{i}", float(i % 2), v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "CustomerID string, ReturnRate double, f array<double>") \
        .withColumn("features", array_to_vector("f"))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(90, 3)) + c for c in ((0, 0, 0), (4, 0, 1), (0, 5, -2))])
    x[50:60] = x[40]  # repeated rows
    return x, _frame(spark, x)


@pytest.fixture(scope="module")
def fitted(points):
    return L.fit(points[1].repartition(5), KS, STARTS)


def _plain_fit(x, keys, k, start):
    centres = []
    for step in range(k):
        weight = ((x[:, None] - np.array(centres)) ** 2).sum(-1).min(1) if centres else np.ones(len(x))
        centres.append(x[np.lexsort((keys, L.race(keys, start, step, weight)))[0]])
    centres = np.array(centres)
    limit = L.TOLERANCE * x.var(axis=0).mean()
    while True:
        group = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        after = np.array([x[group == g].mean(0) if (group == g).any() else centres[g] for g in range(k)])
        still, centres = ((after - centres) ** 2).sum() <= limit, after
        if still:
            return centres, ((x[:, None] - centres) ** 2).sum(-1).min(1).sum()


def test_equals_the_plain_version(points, fitted):
    x, frame = points
    known = {r[0]: r[1] for r in frame.select("CustomerID", F.xxhash64("CustomerID")).collect()}
    keys = np.array([known[f"C{i}"] for i in range(len(x))])
    assert set(fitted) == {(k, s) for k in KS for s in STARTS}
    for (k, start), model in fitted.items():
        centres, cost = _plain_fit(x, keys, k, start)
        assert np.allclose(model.points, centres, atol=1e-6) and model.cost == pytest.approx(cost, abs=1e-4)


def test_partitions_do_not_matter(points, fitted):
    again = L.fit(points[1].repartition(2), KS, STARTS)
    assert all((again[m].points == fitted[m].points).all() and again[m].cost == fitted[m].cost for m in fitted)


def test_fewer_groups_share_the_starts(points, fitted):
    alone = L.fit(points[1], [2], STARTS)
    assert all((alone[2, s].points == fitted[2, s].points).all() for s in STARTS)


def test_jobs_grow_with_passes_not_models(spark, points, monkeypatch):
    passes = []
    real = L._pass
    monkeypatch.setattr(L, "_pass", lambda t, m: passes.append(len(m)) or real(t, m))
    L.fit(points[1], KS, STARTS)
    assert passes[0] == passes[-1] == len(KS) * len(STARTS) and len(passes) < 30


def _plain_silhouette(x, labels):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        others = [apart[i, labels == g].mean() for g in set(labels) - {labels[i]}]
        if own.sum() == 1 or not others:
            out.append(0.0)
            continue
        a, b = apart[i, own].sum() / (own.sum() - 1), min(others)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def test_silhouette_equals_the_plain_version(spark, points, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 37)
    monkeypatch.setattr(S, "TILE_ROWS", 16)
    x, _ = points
    labellings = np.stack([np.arange(len(x)) // 90, np.arange(len(x)) % 2, (np.arange(len(x)) == 3).astype(int),
                           np.zeros(len(x), int)], axis=1)
    rows = [(v.tolist(), [int(g) for g in lab]) for v, lab in zip(x, labellings)]
    frame = spark.createDataFrame(rows, "x array<double>, labels array<int>").repartition(3)
    got = {r["labelling"]: r["silhouette"] for r in S.silhouettes(frame, [3, 2, 2, 1]).collect()}
    for i in range(4):
        assert got[i] == pytest.approx(_plain_silhouette(x, labellings[:, i]), abs=1e-9)


def test_scan_picks_the_true_number(points):
    rows = {r["k"]: r for r in SG.kmeans_scan(points[1], [2, 3, 4], starts=[1, 2, 3]).collect()}
    assert max(rows, key=lambda k: rows[k]["silhouette"]) == 3
    assert rows[2]["inertia"] > rows[3]["inertia"] > rows[4]["inertia"]
    linear = {r["k"]: r["silhouette"] for r in SG.kmeans_scan(points[1], [2, 3], starts=[1, 2], measure="squaredEuclidean").collect()}
    assert linear[3] > rows[3]["silhouette"]


def test_few_and_no_rows(spark):
    same = _frame(spark, np.ones((6, 2)))
    (row,) = SG.kmeans_scan(same, [3], starts=[1, 2]).collect()
    assert (row["inertia"], row["silhouette"]) == (0.0, 0.0)
    assert SG.kmeans_scan(same.limit(0), [2], starts=[1, 2]).collect() == []


def test_few_files_keep_all_cores_busy(spark, points, monkeypatch):
    """Passes over a table that came in one file have a task per core."""
    x, frame = points
    one, cores, tasks = frame.coalesce(1), spark.sparkContext.defaultParallelism, []
    for module in (L, X):
        def spy(table, *a, real=module._pass):
            tasks.append(table.rdd.getNumPartitions())
            return real(table, *a)
        monkeypatch.setattr(module, "_pass", spy)
    fitted = L.fit(one, [2], [1])
    X.fit(one, {1: fitted[2, 1]})
    assert set(tasks) == {cores}
    labelled = one.select(F.col("f").alias("x"), F.array(F.col("ReturnRate").cast("int")).alias("labels"))
    written = []
    monkeypatch.setattr(S.Scratch, "path", lambda self, name, real=S.Scratch.path: written.append(real(self, name)) or written[-1])
    S.silhouettes(labelled, [2])
    assert len(spark.read.parquet(written[0]).inputFiles()) == cores


def test_product_and_differences_agree(monkeypatch):
    """Squares by the matrix product, those that round measured again, are those by differences alone."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    outlier = x * 1e-4
    outlier[0] = 1e4
    labels = np.stack([rng.integers(0, n, 300) for n in (2, 3, 4)], axis=1)
    members = S._members(labels, [2, 3, 4])
    for rows in (x, x[:10].repeat(30, axis=0), 1e6 + 1e-3 * x, outlier, np.ones((300, 5))):
        found = []
        for share in (S.CLOSE, np.inf):
            monkeypatch.setattr(S, "CLOSE", share)
            total = np.zeros((300, 9))
            S.add_distances(total, rows, rows, members)
            found.append(total)
        apart = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
        assert np.allclose(found[1], apart @ members, rtol=1e-12, atol=0)
        assert np.allclose(*found, rtol=1e-9, atol=0)
        monkeypatch.undo()


def test_distances_are_added_tile_by_tile(monkeypatch):
    rng = np.random.default_rng(2)
    mine, other, labels = rng.normal(size=(70, 3)), rng.normal(size=(90, 3)), rng.integers(0, 2, (90, 1))
    members = S._members(labels, [2])
    expected = np.sqrt(L.squared(mine, other)) @ members
    for rows, width in ((64, 1024), (16, 37), (70, 90)):
        monkeypatch.setattr(S, "TILE_ROWS", rows)
        monkeypatch.setattr(S, "TILE_WIDTH", width)
        total = np.zeros((70, 2))
        S.add_distances(total, mine, other, members)
        assert np.allclose(total, expected, atol=1e-12)
    group, least = L.nearest(mine.T, other[:5])
    apart = L.squared(mine, other[:5])
    assert (group == apart.argmin(1)).all() and (least == apart.min(1)).all()
