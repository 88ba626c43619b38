"""Classification metrics over (label, score) tables.

Threshold metrics (accuracy, precision, recall, F1, confusion matrix, per-class report)
are conditional sums in one aggregate. Ranking metrics (exact ROC-AUC with ties counted
half, the ROC curve) need, per distinct score, the number of negatives ranked below it.
That is a prefix sum over distinct scores, computed by :func:`prefix_sums` without a
global single-task window: distinct scores are cut into ranges of equal size at
approximate quantiles, a window runs inside each range, and range offsets come from a
table of one row per range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.sources.scratch import Scratch

R6 = 6
RANGE_ROWS = 1_000_000


def prefix_sums(df: DataFrame, key: str, measures: Sequence[str],
                range_rows: int = RANGE_ROWS, suffix: str = "_before") -> DataFrame:
    """For a table with one row per distinct ``key``, add for every measure m the sum of
    m over rows with a smaller key (``m + suffix``).

    The rows are written once. They are cut into key ranges of about ``range_rows`` rows at
    approximate quantiles of ``key``; windows run per range and one small table carries the
    range offsets, so the ranges grow in number, not in size.
    """
    scratch = Scratch(df.sparkSession, "prefix")
    df = scratch.table(df, "keys")
    n_ranges = max(1, -(-df.count() // range_rows))
    if n_ranges == 1:
        rng = F.lit(0)
    else:
        fracs = [i / n_ranges for i in range(1, n_ranges)]
        cuts = df.agg(F.percentile_approx(key, fracs, 20 * n_ranges)).scalar()
        # range index = number of distinct cut points below the key: the key's position in
        # the sorted union of the cuts and the key itself (one subquery reference, no lambda)
        k = F.col(key)
        rng = F.array_position(F.sort_array(F.array_union(cuts, F.array(k))), k) - 1
    ranged = df.withColumn("__rng", rng)
    w_in = Window.partitionBy("__rng").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    for m in measures:
        ranged = ranged.withColumn(f"__in_{m}", F.coalesce(F.sum(m).over(w_in), F.lit(0)))
    tot = df.withColumn("__rng", rng).groupBy("__rng").agg(*[F.sum(m).alias(f"__t_{m}") for m in measures])
    w_r = Window.orderBy("__rng").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    for m in measures:
        tot = tot.withColumn(f"__o_{m}", F.coalesce(F.sum(f"__t_{m}").over(w_r), F.lit(0)))
    tot = tot.select("__rng", *[f"__o_{m}" for m in measures])
    out = ranged.join(F.broadcast(tot), "__rng")
    for m in measures:
        out = out.withColumn(m + suffix, F.col(f"__o_{m}") + F.col(f"__in_{m}"))
    return out.drop("__rng", *[f"__o_{m}" for m in measures], *[f"__in_{m}" for m in measures])


def exact_quantiles(df: DataFrame, col: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles, as ``percentile`` gives them, from counts per value
    and their prefix sums: no task holds all distinct values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"))
    sums = prefix_sums(counts, "v", ["n"])
    end = F.col("n_before") + F.col("n")
    total = sums.agg(F.sum("n")).first()[0] or 0
    wanted, found = [(total - 1) * q for q in shares], []
    for q, place in enumerate(wanted):
        for name, at in (("lo", math.floor(place)), ("hi", math.ceil(place))):
            found.append(F.max(F.when((F.col("n_before") <= at) & (end > at), F.col("v"))).alias(f"{name}{q}"))
    row = sums.agg(*found).first()
    return [None if row[f"lo{q}"] is None else row[f"lo{q}"] + (row[f"hi{q}"] - row[f"lo{q}"]) * (p - math.floor(p))
            for q, p in enumerate(wanted)]


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score: pos, neg."""
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(score).alias("__s"))
              .agg(F.count_if(F.col(label) == 1).alias("pos"),
                   F.count_if(F.col(label) != 1).alias("neg")))


def auc(df: DataFrame, label: str = "RTO", score: str = "Risk",
        higher_is_positive: bool = True) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney, ties count half): one row, column ``auc``."""
    sc = score_counts(df, label, score)
    if not higher_is_positive:
        sc = sc.withColumn("__s", -F.col("__s"))
    ps = prefix_sums(sc, "__s", ["neg"])
    return ps.agg(
        F.round(F.try_divide(F.sum(F.col("pos") * F.col("neg_before") + F.lit(0.5) * F.col("pos") * F.col("neg")),
                             F.sum("pos").cast("double") * F.sum("neg")), R6).alias("auc"))


def roc_curve(df: DataFrame, label: str = "RTO", score: str = "Risk",
              higher_is_positive: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score (rows scoring >= threshold are called
    positive); all points are kept, collinear ones included."""
    sc = score_counts(df, label, score)
    sign = 1 if higher_is_positive else -1
    # descending order of the score = ascending order of -score
    sc = sc.withColumn("__k", F.lit(-sign) * F.col("__s"))
    ps = prefix_sums(sc, "__k", ["pos", "neg"])
    return (ps.withColumn("__P", sc.agg(F.sum("pos")).scalar())
              .withColumn("__N", sc.agg(F.sum("neg")).scalar())
              .select(F.col("__s").alias("threshold"),
                      F.round(F.try_divide(F.col("neg_before") + F.col("neg"), F.col("__N")), R6).alias("fpr"),
                      F.round(F.try_divide(F.col("pos_before") + F.col("pos"), F.col("__P")), R6).alias("tpr")))


def confusion_counts(df: DataFrame, label: str = "RTO", pred: str = "Pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"))


def threshold_metrics(df: DataFrame, label: str = "RTO", pred: str = "Pred") -> DataFrame:
    """accuracy, precision, recall, f1 (0 when undefined), one row."""
    c = confusion_counts(df, label, pred)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return c.select(F.round(F.try_divide(tp + tn, tp + tn + fp + fn), R6).alias("accuracy"),
                    F.round(prec, R6).alias("precision"), F.round(rec, R6).alias("recall"),
                    F.round(f1, R6).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "RTO", pred: str = "Pred") -> DataFrame:
    """2x2 long form: (actual, predicted, n), all four cells present."""
    c = confusion_counts(df, label, pred)
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")))
    return c.select(F.inline(cells))


def class_report(df: DataFrame, label: str = "RTO", pred: str = "Pred",
                 names: tuple[str, str] = ("Delivered", "Returned")) -> DataFrame:
    """Per class precision / recall / F1 / support, plus macro and weighted averages."""
    c = confusion_counts(df, label, pred)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def prf(t, f_p, f_n):
        p = F.coalesce(F.try_divide(t, t + f_p), F.lit(0.0))
        r = F.coalesce(F.try_divide(t, t + f_n), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * t, 2 * t + f_p + f_n), F.lit(0.0))
        return p, r, f

    p0, r0, f0 = prf(tn, fn, fp)   # class 0 seen as the positive class
    p1, r1, f1 = prf(tp, fp, fn)
    s0, s1 = tn + fp, tp + fn
    n = s0 + s1

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), F.round(p, R6).alias("precision"),
                        F.round(r, R6).alias("recall"), F.round(f, R6).alias("f1"),
                        s.cast("bigint").alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", F.try_divide(p0 * s0 + p1 * s1, n), F.try_divide(r0 * s0 + r1 * s1, n),
            F.try_divide(f0 * s0 + f1 * s1, n), n))
    return c.select(F.inline(rows))


def calibration(df: DataFrame, label: str = "RTO", risk: str = "Risk",
                group: str | None = None) -> DataFrame:
    """Mean predicted risk vs real rate (optionally per group, e.g. model or decile)."""
    g = [group] if group else []
    agg = [F.round(F.avg(risk), R6).alias("mean_predicted"),
           F.round(F.avg(label), R6).alias("actual_rate"), F.count(F.lit(1)).alias("n")]
    return df.groupBy(*g).agg(*agg) if g else df.agg(*agg)
