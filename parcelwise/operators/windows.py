"""Window-style operators written so that no single task sees an unbounded group.

* :func:`prior_history` -- per shopper, orders and returns strictly before each order.
  A plain ``Window.partitionBy(customer)`` puts every order of a hot shopper into one
  task. Here the running totals are built in three levels (shopper -> day -> block of
  order keys), each level a window over a pre-aggregated table whose group sizes are
  bounded by the calendar or by the block width, then added back with equi-joins.
* :func:`exact_rank` -- exact 1-based row number within a group by a uniform 32-bit hash,
  computed from hash-bucket counts plus a row number inside each bucket. Used for
  stratified splits and folds: the class with most rows never lands in one task.
* :func:`split_and_folds` -- hold-out flag and k-fold id from :func:`exact_rank`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions.exprs import hash_bits32
from parcelwise.sources.scratch import Scratch

# Width of one block of sequence keys in the finest level of prior_history (rows per
# window group are bounded by this, since sequence keys are unique).
SEQ_BLOCK = 1 << 20
# Number of hash buckets per group in exact_rank (bounds the small prefix-sum table).
RANK_BUCKET_BITS = 16


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal ``keys`` where NULL equals NULL; the keys come once, from ``left``."""
    other = right.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"__of_{k}" for k in keys])


def _without_nulls(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns without NULL that are equal in two rows if and only if ``keys`` are (NULL equals NULL)."""
    zero = {"string": "", "boolean": "false", "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}
    out = {}
    for k in keys:
        kind = df.schema[k].dataType.simpleString()
        out[f"__key_{k}"] = F.coalesce(F.col(k), F.lit(zero.get(kind, "0")).cast(kind))
        out[f"__none_{k}"] = F.col(k).isNull()
    return out


def prior_history(df: DataFrame, cust: str = "CustomerID", day: str = "OrderDay",
                  seq: str = "OrderKey", flag: str = "RTO",
                  out_orders: str = "PriorOrders", out_returns: str = "PriorReturns",
                  seq_block: int = SEQ_BLOCK, checkpoint_input: bool = True) -> DataFrame:
    """Add, per row, the count of earlier rows of the same ``cust`` and the sum of ``flag``
    over them, in (``day``, ``seq``) order -- the window
    ``partitionBy(cust).orderBy(day, seq).rowsBetween(unboundedPreceding, -1)``.

    ``seq`` must be a unique integer key. Result is 0/0 for a shopper's first order. Rows
    without a shopper form one group and rows without a day come first, as in the window.
    """
    blk = "__blk"
    base = df.withColumn(blk, F.floor(F.col(seq) / F.lit(seq_block)))
    if checkpoint_input:
        # the input rows are computed once and written as Parquet to the shared checkpoint
        # folder: all three levels read that copy (the input plan -- joins, hashing -- runs
        # once; the block and day levels scan only their five columns), and lineage is cut
        base = Scratch(df.sparkSession, "history").table(base, "input")

    # level 3: rows inside one (cust, day, block) -- at most seq_block rows per group. The
    # window deals and sorts the rows by the very columns of the join below, so that the rows,
    # the widest of what moves, are shuffled and sorted once
    keys = [cust, day, blk]
    held = _without_nulls(base, keys)
    w_row = (Window.partitionBy(*held).orderBy(seq)
             .rowsBetween(Window.unboundedPreceding, -1))
    rows = (base.withColumns(held).drop(*keys)
            .withColumn("__n3", F.count(F.lit(1)).over(w_row))
            .withColumn("__r3", F.coalesce(F.sum(flag).over(w_row), F.lit(0))))

    # level 2: (cust, day, block) totals, running within (cust, day). A plain aggregate of
    # the staged rows: it scans five columns and combines map-side, so only one partial
    # row per (cust, day, block) and task is shuffled.
    blocks = base.groupBy(cust, day, blk).agg(F.count(F.lit(1)).alias("__bn"),
                                               F.sum(flag).alias("__br"))
    w_blk = Window.partitionBy(cust, day).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (blocks
              .withColumn("__n2", F.coalesce(F.sum("__bn").over(w_blk), F.lit(0)))
              .withColumn("__r2", F.coalesce(F.sum("__br").over(w_blk), F.lit(0))))

    # level 1: (cust, day) totals, running within cust -- at most one row per calendar day
    days = blocks.groupBy(cust, day).agg(F.sum("__bn").alias("__dn"), F.sum("__br").alias("__dr"))
    w_day = Window.partitionBy(cust).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = (days
            .withColumn("__n1", F.coalesce(F.sum("__dn").over(w_day), F.lit(0)))
            .withColumn("__r1", F.coalesce(F.sum("__dr").over(w_day), F.lit(0)))
            .select(cust, day, "__n1", "__r1"))

    offsets = (join_null_safe(blocks, days, [cust, day])
               .select(cust, day, blk,
                       (F.col("__n1") + F.col("__n2")).alias("__no"),
                       (F.col("__r1") + F.col("__r2")).alias("__ro")))

    out = (rows.join(offsets.withColumns(held).drop(*keys), [*held])
           .withColumn(out_orders, (F.col("__no") + F.col("__n3")).cast("int"))
           .withColumn(out_returns, (F.col("__ro") + F.col("__r3")).cast("int")))
    back = {k: F.when(~F.col(f"__none_{k}"), F.col(f"__key_{k}")).alias(k) for k in (cust, day)}
    return out.select(*[back.get(c, F.col(c)) for c in [*df.columns, out_orders, out_returns]])


def exact_rank(df: DataFrame, group_cols: Sequence[str], id_col: str, salt: str,
               out: str = "__rank", bucket_bits: int = RANK_BUCKET_BITS) -> DataFrame:
    """Exact ``row_number()`` over (partition by group_cols order by h, id_col), where
    h = the 32-bit md5 hash of ``id_col`` with ``salt``.

    Level 1 counts rows per (group, top-``bucket_bits`` of h): at most 2^bucket_bits rows
    per group, so its running sum is a window over a table bounded by the parameter.
    Level 2 numbers rows inside a bucket; buckets are uniform in size because h is.
    """
    g = list(group_cols)
    shift = 32 - bucket_bits
    h, b = "__h", "__b"
    # a row without an id is placed by a hash of all its columns
    base = (df.withColumn(h, F.coalesce(hash_bits32(id_col, salt),
                                        F.pmod(F.xxhash64(*df.columns), F.lit(1 << 32))))
              .withColumn(b, F.shiftright(F.col(h), shift)))
    w_in = Window.partitionBy(*g, b).orderBy(h, id_col)
    ranked = base.withColumn("__rn", F.row_number().over(w_in))
    # bucket sizes: a map-side combined count (one partial row per bucket and task)
    counts = base.groupBy(*g, b).agg(F.count(F.lit(1)).alias("__bc"))
    w_b = Window.partitionBy(*g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__off", F.coalesce(F.sum("__bc").over(w_b), F.lit(0))).drop("__bc")
    return (join_null_safe(ranked, counts, [*g, b])
            .withColumn(out, (F.col("__off") + F.col("__rn")).cast("bigint"))
            .drop(h, b, "__off", "__rn"))


def split_and_folds(df: DataFrame, label: str | None, id_col: str, seed: int = 42,
                    test_share: float = 0.25, n_folds: int = 5) -> DataFrame:
    """Deterministic stratified hold-out and k folds.

    Within each class (or over all rows when ``label`` is None), rows are ranked by the
    md5 of ``id_col || '-' || seed``; the first ceil(n * test_share) are the hold-out
    (``is_test`` = 1) and ``fold`` = rank mod n_folds.
    """
    groups = [label] if label else []
    ranked = exact_rank(df, groups, id_col, str(seed), out="split_rank")
    if groups:
        # one row per class: bounded by the number of classes
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
        joined = join_null_safe(ranked, F.broadcast(sizes), groups)
    else:
        joined = ranked.withColumn("__n", df.agg(F.count(F.lit(1))).scalar())
    cut_col = F.ceil(F.col("__n") * F.lit(float(test_share)))
    return (joined
            .withColumn("is_test", (F.col("split_rank") <= cut_col).cast("int"))
            .withColumn("fold", (F.col("split_rank") % F.lit(n_folds)).cast("int"))
            .drop("__n"))


def middle_and_ends(df: DataFrame, score: str, id_col: str, salt: str = "mid",
                    n_end: int = 2) -> DataFrame:
    """The ``n_end`` lowest, the two middle (0-based positions n//2 - 1 and n//2) and the
    ``n_end`` highest rows in (score, h(id), id) order, with ``position`` and ``part``.

    Ends are distributed top-k (``orderBy().limit()``). The middle rows are found without
    sorting all rows: a per-score count table (bounded by the distinct scores) locates the
    score holding each middle position; only rows of those scores are ranked, with the
    skew-safe :func:`exact_rank` (a hot score is split over hash buckets).
    """
    h = "__h"
    df = df.where(F.col(score).isNotNull())  # an order without a score has no place in the order
    keyed = df.withColumn(h, hash_bits32(id_col, salt))
    n_all = df.agg(F.count(F.lit(1))).scalar()
    low = keyed.orderBy(score, h, id_col).limit(n_end).withColumn("part", F.lit("lowest"))
    high = keyed.orderBy(F.desc(score), F.desc(h), F.desc(id_col)).limit(n_end) \
        .withColumn("part", F.lit("highest"))

    per = df.groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    targets = (per.withColumn("__n", n_all)
                  .withColumn("__pos", F.explode(F.array(
                      (F.floor(F.col("__n") / 2) - 1).cast("bigint"),
                      F.floor(F.col("__n") / 2).cast("bigint"))))
                  .where((F.col("__pos") >= F.col("__before"))
                         & (F.col("__pos") < F.col("__before") + F.col("__c")))
                  .select(score, "__pos", "__before"))
    cand = keyed.join(F.broadcast(targets.select(score).distinct()), score)
    ranked = exact_rank(cand.drop(h), [score], id_col, salt, out="__r")
    mid = (ranked.join(F.broadcast(targets), score)
                 .where(F.col("__r") - 1 + F.col("__before") == F.col("__pos"))
                 .drop("__r", "__before", "__pos")
                 .withColumn("part", F.lit("middle")))
    cols = [c for c in df.columns] + ["part"]
    return low.select(*cols).unionByName(mid.select(*cols)).unionByName(high.select(*cols))
