import itertools
import random

import numpy as np

from parcelwise.operators import knn as K
from parcelwise.operators import rules as RU


def _cod(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        tier = rnd.choice(["Tier-1", "Tier-2", "Tier-3", None])
        addr = rnd.choice(["Complete", "Vague"])
        rto = int(rnd.random() < (0.6 if (tier == "Tier-3" and addr == "Vague") else 0.3))
        rows.append((f"O{i}", tier, rnd.choice(["A", "B"]), addr, rnd.choice(["App", "Web"]),
                     float(rnd.choice([5, 20, 30, 60, 150])), int(rnd.random() < 0.3), rto))
    return spark.createDataFrame(rows, "OrderID string, CityTier string, Category string, "
                                       "AddressQuality string, Device string, DiscountPct double, "
                                       "FirstTime int, RTO int")


def test_cube_rules_equal_brute_force_and_fpgrowth(spark):
    cod = _cod(spark)
    cube = {r.combo: r for r in RU.rules_cube(cod, min_support=0.02).collect()}
    fp = {r.combo: r for r in RU.rules_returned(cod, min_support=0.02).collect()}
    assert set(cube) == set(fp) and cube
    for k in cube:
        assert abs(cube[k].lift - fp[k].lift) < 1e-6
    # brute force over baskets
    t = RU.basket_traits(cod).toPandas()
    n, base = len(t), (t.out == "RETURNED").mean()
    want = {}
    for size in range(2, 7):
        for traits in itertools.combinations(RU.TRAITS, size):
            for key, grp in t.groupby(list(traits)):
                r = (grp.out == "RETURNED").sum()
                if r / n >= 0.02 and (r / len(grp)) / base >= 1.0:
                    want[" + ".join(sorted(key))] = r / n
    assert set(want) == set(cube)
    assert all(abs(cube[k].support - round(v, 6)) < 1e-9 for k, v in want.items())


def test_itemsets_and_rules_equal_fpgrowth(spark):
    from pyspark.ml.fpm import FPGrowth
    cod = _cod(spark)
    model = FPGrowth(itemsCol="items", minSupport=0.02, minConfidence=0.0).fit(RU.baskets(cod))
    want = {" + ".join(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect()}
    assert {r.itemset: r.freq for r in RU.frequent_itemsets(cod).collect()} == want
    rules = {(" + ".join(sorted(r.antecedent)), r.consequent[0]): r.lift
             for r in model.associationRules.collect() if r.lift >= 1.0}
    got = {(r.antecedent, r.consequent): r.lift for r in RU.rules_lift(cod).collect()}
    assert set(got) == set(rules) and all(abs(got[k] - rules[k]) < 1e-6 for k in rules)


def test_shared_text_of_two_traits_stays_two_items(spark):
    rows = [(f"O{i}", "Tier-1", "Unknown", None, "Unknown", 10.0, 0, i % 2) for i in range(40)]
    cod = spark.createDataFrame(rows, "OrderID string, CityTier string, Category string, AddressQuality string, "
                                      "Device string, DiscountPct double, FirstTime int, RTO int")
    items = RU.baskets(cod).first()["items"]
    assert len(set(items)) == 7 and {"cat Unknown", "dev Unknown"} <= set(items)
    assert RU.frequent_itemsets(cod).count() == 2 ** 6 * 3 - 1


def test_missing_and_out_of_range_traits_are_items(spark):
    t = {r.OrderID: r for r in RU.basket_traits(_cod(spark)).collect()}
    assert any(r.tier == "Tier unknown" for r in t.values())
    assert any(r.disc == "disc unknown" for r in t.values())


def test_knn_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5)).round(1)   # rounding creates distance ties
    y = (rng.random(120) < 0.4).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(120)], "id long, x array<double>, y int")
    got = {r.id: r for r in K.knn_scores(df, df, k=7, train_id="id", query_id="id",
                                         exclude_self=True, block_rows=25).collect()}
    for i in range(120):
        d = K._exact(x, x[i])
        d[i] = np.inf
        order = np.lexsort((np.arange(120), d))[:7]
        assert got[i].neighbours == order.tolist()
        assert got[i].n_positive == int(y[order].sum())


def test_knn_tight_cluster_far_from_origin():
    """Rounding of the expanded distance must not lose a neighbour (block scorer, 40 seeds)."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        x = 1e4 + rng.normal(scale=1e-4, size=(400, 8)).round(6)
        ids = np.arange(400)
        near = K.Nearest(x[:40], ids[:40], 5, True)
        for at in range(0, 400, 150):
            near.add(x[at:at + 150], ids[at:at + 150], np.ones(len(x[at:at + 150])))
        for i in range(40):
            d = K._exact(x, x[i])
            d[i] = np.inf
            assert near.best[i][1].tolist() == np.lexsort((ids, d))[:5].tolist()


def _groups(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 12))[rng.integers(0, 40, n)] * 10 + rng.normal(size=(n, 12)) * 0.3
    x[:900] = x[0]  # copies: many ties, one hot list
    return x


def test_index_skips_and_stays_exact(spark):
    """Recall 1 while most pairs are never measured."""
    x = _groups()
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, x array<double>, y int")
    rows = K.knn_scores(df, df, k=9, train_id="id", query_id="id", exclude_self=True, block_rows=50).collect()
    assert len(rows) == len(x)
    for r in rows[::13]:
        d = K._exact(x, x[r.id])
        d[r.id] = np.inf
        assert r.neighbours == np.lexsort((np.arange(len(x)), d))[:9].tolist()
    assert sum(r.measured for r in rows) < 0.35 * len(x) ** 2


def test_files_are_read_once_per_held_queries(spark, monkeypatch):
    """Arrow batches of 10 rows do not multiply the reading."""
    x = _groups(300)
    df = spark.createDataFrame([(f"k{i}", v.tolist(), 1) for i, v in enumerate(x)], "id string, x array<double>, y int")
    want = {r.id: r.neighbours for r in K.knn_scores(df, df, k=3, train_id="id", query_id="id").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r.id: r.neighbours for r in K.knn_scores(df, df, k=3, train_id="id", query_id="id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 300


def test_few_no_and_empty_rows(spark):
    schema = "id long, x array<double>, y int"
    two = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [5.0, 5.0], 0), (3, None, 1)], schema)
    got = {r.id: r for r in K.knn_scores(two, two, k=5, train_id="id", query_id="id").collect()}
    assert {i: r.neighbours for i, r in got.items()} == {1: [1, 2], 2: [2, 1]} and got[1].prob == 0.5
    none = K.knn_scores(two.limit(0), two, k=5, train_id="id", query_id="id").collect()
    assert [(r.id, r.neighbours, r.prob) for r in sorted(none)] == [(1, [], 0.0), (2, [], 0.0)]
    assert K.knn_scores(two, two.limit(0), k=5, train_id="id", query_id="id").collect() == []


def test_knn_memory_does_not_grow_with_copies():
    import tracemalloc

    import numpy as np

    from parcelwise.operators.knn import Nearest
    rng = np.random.default_rng(5)
    few = rng.normal(size=(8, 64))
    rows = few[np.arange(8192) % 8]          # each vector a thousand times
    nearest = Nearest(few[np.arange(2048) % 8], np.arange(2048), 25, True)
    tracemalloc.start()
    nearest.add(rows, np.arange(8192), np.ones(8192))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (nearest.distance == 0).all() and (nearest.known[:, 0] < 16).all()
    assert peak < 400e6, peak                 # all pairs' vectors gathered at once took over 1,100 MB


def test_most_pairs_of_one_hot_rows_are_skipped(spark):
    """Numbers beside one-hot levels, as model rows have them: residuals of centres skipped a sixth of the pairs."""
    rng = np.random.default_rng(11)
    n, hot = 6000, [np.eye(m)[rng.integers(0, m, 6000)] for m in (3, 12, 8, 4)]
    x = np.concatenate([rng.normal(size=(n, 4)), *hot], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, x array<double>, y int")
    rows = K.knn_scores(df, df.where("id % 20 = 0"), k=5, train_id="id", query_id="id", exclude_self=True).collect()
    assert len(rows) == n // 20
    for r in rows:
        d = K._exact(x, x[r.id])
        d[r.id] = np.inf
        assert r.neighbours == np.lexsort((np.arange(n), d))[:5].tolist()
    assert sum(r.measured for r in rows) < 0.3 * n * len(rows)


def test_ids_that_repeat_are_all_left_out(spark):
    """A training id that comes twice must not cost a query its k-th neighbour."""
    df = spark.createDataFrame([(i // 2, [float(i // 2) ** 2, 0.0], 1) for i in range(40)], "id long, x array<double>, y int")
    got = K.knn_scores(df, df.where("id = 10").limit(1), k=3, train_id="id", query_id="id", exclude_self=True).first()
    assert got.neighbours == [9, 9, 11]


def test_hundreds_of_rare_levels_are_parted_evenly():
    """No vine with a cut per level: neither deep recursion nor hundreds of passes over a file."""
    x = np.eye(1500)[np.arange(6000) % 1500]
    groups = K._together(x, 64)
    assert sorted(np.concatenate(groups).tolist()) == list(range(6000))
    assert max(map(len, groups)) <= 64 and len(groups) < 750  # a cut per level made over 1,400
    cells = K.Cells(x)
    assert cells.of(x).max() < cells.size
