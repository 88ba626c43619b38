import random

import pandas as pd

from parcelwise.operators import windows as W


def _orders(n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        cust = "HOT" if rnd.random() < 0.4 else f"C{rnd.randint(1, 30)}"   # one hot shopper
        rows.append((i * 7 + rnd.randint(0, 3) * 1000, cust, rnd.randint(0, 5), int(rnd.random() < 0.3)))
    # unique seq keys
    seen, out = set(), []
    for seq, c, d, r in rows:
        if seq not in seen:
            seen.add(seq)
            out.append((seq, c, d, r))
    return out


def test_prior_history_matches_plain_window(spark):
    rows = _orders()
    df = spark.createDataFrame(rows, "seq long, cust string, day int, ret int")
    got = W.prior_history(df, cust="cust", day="day", seq="seq", flag="ret", seq_block=16).toPandas()
    pdf = pd.DataFrame(rows, columns=["seq", "cust", "day", "ret"]).sort_values(["cust", "day", "seq"])
    pdf["po"] = pdf.groupby("cust").cumcount()
    pdf["pr"] = pdf.groupby("cust")["ret"].cumsum() - pdf["ret"]
    m = got.merge(pdf, on="seq")
    assert len(m) == len(rows)
    assert (m.PriorOrders == m.po).all() and (m.PriorReturns == m.pr).all()


def test_exact_rank_is_row_number(spark):
    rows = [(f"ORD{i}", i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, g int")
    got = W.exact_rank(df, ["g"], "id", "42", out="rk", bucket_bits=4).toPandas()
    import hashlib
    pdf = pd.DataFrame(rows, columns=["id", "g"])
    pdf["h"] = [int(hashlib.md5(f"{i}-42".encode()).hexdigest()[:8], 16) for i in pdf.id]
    pdf = pdf.sort_values(["g", "h", "id"])
    pdf["want"] = pdf.groupby("g").cumcount() + 1
    m = got.merge(pdf, on="id")
    assert (m.rk == m.want).all()


def test_split_and_folds_partition(spark):
    rows = [(f"ORD{i}", int(i % 3 == 0)) for i in range(301)]
    df = spark.createDataFrame(rows, "id string, y int")
    s = W.split_and_folds(df, "y", "id", test_share=0.25, n_folds=5).toPandas()
    for y, grp in s.groupby("y"):
        assert grp.is_test.sum() == -(-len(grp) * 25 // 100)
        assert set(grp.fold) == {0, 1, 2, 3, 4}
    assert len(s) == 301


def test_middle_and_ends(spark):
    rows = [(f"ORD{i}", 300 + (i * 37) % 11) for i in range(101)]   # many ties per score
    df = spark.createDataFrame(rows, "id string, score int")
    got = W.middle_and_ends(df, "score", "id", salt="mid").toPandas()
    import hashlib
    pdf = pd.DataFrame(rows, columns=["id", "score"])
    pdf["h"] = [int(hashlib.md5(f"{i}-mid".encode()).hexdigest()[:8], 16) for i in pdf.id]
    pdf = pdf.sort_values(["score", "h", "id"]).reset_index(drop=True)
    n = len(pdf)
    want = set(pdf.id.iloc[[0, 1, n // 2 - 1, n // 2, n - 2, n - 1]])
    assert set(got.id) == want and len(got) == 6


def test_rows_without_keys_are_kept(spark):
    rows = [(1, None, 1, 1), (2, None, 2, 0), (3, "A", None, 1), (4, "A", 1, 0), (5, "A", 2, 1)]
    df = spark.createDataFrame(rows, "seq long, cust string, day int, ret int")
    got = {r.seq: (r.PriorOrders, r.PriorReturns)
           for r in W.prior_history(df, cust="cust", day="day", seq="seq", flag="ret").collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (1, 1), 5: (2, 1)}
    ids = spark.createDataFrame([("a", 1), (None, 1), (None, 0), ("b", None), (None, None)], "id string, y int")
    ranked = W.exact_rank(ids, ["y"], "id", "42", out="rk").collect()
    assert sorted((str(r.y), r.rk) for r in ranked) == [("0", 1), ("1", 1), ("1", 2), ("None", 1), ("None", 2)]
    assert W.split_and_folds(ids, "y", "id").count() == 5
    assert W.split_and_folds(ids, None, "id").count() == 5


def test_prior_history_shuffles_the_rows_once(spark):
    rows = [(i, None if i % 7 == 0 else f"C{i % 5}", None if i % 11 == 0 else i % 3, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, cust string, day int, ret int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = W.prior_history(df, cust="cust", day="day", seq="seq", flag="ret", seq_block=16)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {r["seq"]: (r["PriorOrders"], r["PriorReturns"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want, seen = {}, {}
    for seq, cust, _, ret in sorted(rows, key=lambda r: (r[1] or "", -1 if r[2] is None else r[2], r[0])):
        n, back = seen.get(cust, (0, 0))
        want[seq], seen[cust] = (n, back), (n + 1, back + ret)
    assert found == want
    # the upper side of the last join: from its sort down to the scan there is one exchange
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    at = lines[join].index("SortMergeJoin")
    rows_side = []
    for line in lines[join + 1:]:
        depth = len(line) - len(line.lstrip(" :+-"))
        if depth <= at + 3 and rows_side and not line[at:at + 1] == ":":
            break
        rows_side.append(line)
    assert sum("Exchange" in line for line in rows_side) == 1, plan
