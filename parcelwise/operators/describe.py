"""Descriptive aggregates: headline KPIs, return rate by a lens, pivots, correlations,
the per-shopper table, histograms, mode, distinct levels, the validation report.

Every function is one or two aggregate passes; scalars that later rows need (overall rate,
quartile edges, min/max) enter row expressions as scalar subqueries (``DataFrame.scalar``),
never collected to the driver. pandas-style semantics kept on purpose: NULL group keys are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelwise.functions import exprs as X
from parcelwise.operators import metrics as M

R6 = 6  # decimals used for rates in comparable outputs


def kpi_headline(df: DataFrame) -> DataFrame:
    """orders, distinct shoppers, overall / COD / prepaid return rates (one pass)."""
    cod = F.col("IsCOD") == 1
    return df.agg(
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct("CustomerID").alias("shoppers"),
        F.round(F.avg("RTO"), R6).alias("overall_rate"),
        F.round(F.avg(F.when(cod, F.col("RTO"))), R6).alias("cod_rate"),
        F.round(F.avg(F.when(~cod, F.col("RTO"))), R6).alias("prepaid_rate"),
    )


def rate_by(df: DataFrame, col: str | "F.Column", min_n: int = 20,
            level_name: str = "level") -> DataFrame:
    """Mean RTO and count per level (NULL levels dropped), keeping levels with n >= min_n,
    flagged against the overall rate of ``df``; ``display_rank`` gives the display order
    (ascending rate, level as tie-break), ranked over the per-level rows, not order rows."""
    lvl = X.col_(col)
    per = (df.where(lvl.isNotNull())
             .groupBy(lvl.alias(level_name))
             .agg(F.avg("RTO").alias("__mean"), F.count(F.lit(1)).alias("n")))
    overall = df.agg(F.avg("RTO")).scalar()
    kept = per.where(F.col("n") >= min_n).withColumn("__overall", overall)
    rate = F.round("__mean", R6)
    # display order over the aggregated levels only (one row per level)
    order = Window.orderBy(rate, F.col(level_name))
    return kept.select(
        F.col(level_name),
        rate.alias("return_rate"),
        F.col("n"),
        F.round("__overall", R6).alias("overall_rate"),
        F.when(F.col("__mean") > F.col("__overall"), F.lit("above")).otherwise(F.lit("below"))
         .alias("vs_overall"),
        F.row_number().over(order).cast("bigint").alias("display_rank"),
    )


def with_discount_band(df: DataFrame) -> DataFrame:
    return df.withColumn("DiscountBand", X.cut("DiscountPct", X.DISCOUNT_EDGES, X.DISCOUNT_LABELS))


def with_prior_band(df: DataFrame) -> DataFrame:
    return df.withColumn("PriorBand", X.cut("PriorRTORate", X.PRIOR_RATE_EDGES, X.PRIOR_RATE_LABELS))


def with_history_depth(df: DataFrame) -> DataFrame:
    return df.withColumn("HistoryDepth", X.cut("PriorOrders", X.HISTORY_EDGES, X.HISTORY_LABELS))


def with_value_quartile(df: DataFrame, col: str = "OrderValue") -> DataFrame:
    """Quartile bands from exact interpolated quartiles (first band closed on the left).

    The five edges (min, exact 25/50/75 % points, max) come from counts per value.
    """
    edges = M.exact_quantiles(df, col, (0.0, 0.25, 0.5, 0.75, 1.0))
    edge_cols = [F.lit(e).cast("double") for e in edges]
    return df.withColumn("ValueQuartile", X.cut_by_columns(col, edge_cols, X.VALUE_QUARTILE_LABELS))


def first_vs_repeat(df: DataFrame) -> DataFrame:
    who = F.when(F.col("FirstTime") == 1, F.lit("First-time buyer")).otherwise(F.lit("Repeat buyer"))
    return rate_by(df.withColumn("Who", who), "Who", min_n=0)


def pivot_tier_category(df: DataFrame, categories: Sequence[str] | None = None,
                        tiers: Sequence[str] = ("Tier-1", "Tier-2", "Tier-3")) -> DataFrame:
    """Mean RTO, rows = tier (fixed order, absent tiers kept), columns = category.

    Long form (tier, category, rate) is the stable, comparable output; pass explicit
    ``categories`` to get the wide pivot without an extra distinct job.
    """
    long = (df.where(F.col("CityTier").isNotNull() & F.col("Category").isNotNull())
              .groupBy("CityTier", "Category")
              .agg(F.round(F.avg("RTO"), R6).alias("return_rate"),
                   F.count(F.lit(1)).alias("n")))
    if categories is None:
        return long
    wide = (df.where(F.col("CityTier").isNotNull())
              .groupBy("CityTier").pivot("Category", list(categories)).agg(F.avg("RTO")))
    dim = df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(tiers)],
                                          "CityTier string, tier_order int")
    return F.broadcast(dim).join(wide, "CityTier", "left").orderBy("tier_order").drop("tier_order")


CORR_COLUMNS = ["PriorRTORate", "FirstTime", "DiscountPct", "OrderValue",
                "PriorOrders", "Items", "OrderHour"]


def corr_with_rto(df: DataFrame, cols: Sequence[str] = CORR_COLUMNS) -> DataFrame:
    """Pearson correlation of RTO with each numeric column, from one aggregate pass
    (pairwise-complete rows, like pandas; deviations, not raw squares). A column with zero
    variance gives NULL instead of an error."""
    aggs = []
    for c in cols:
        ok = F.col(c).isNotNull() & F.col("RTO").isNotNull()
        x = F.when(ok, F.col(c).cast("double"))
        y = F.when(ok, F.col("RTO").cast("double"))
        aggs += [F.covar_pop(x, y).alias(f"{c}__xy"), F.stddev_pop(x).alias(f"{c}__x"), F.stddev_pop(y).alias(f"{c}__y")]
    one = df.agg(*aggs)
    rows = []
    for c in cols:
        xy, sx, sy = F.col(f"{c}__xy"), F.col(f"{c}__x"), F.col(f"{c}__y")
        r = F.when((sx > 0) & (sy > 0), xy / (sx * sy))
        rows.append(F.struct(F.lit(c).alias("feature"), F.round(r, R6).alias("corr")))
    return one.select(F.inline(F.array(*rows)))


def cat_mean_value(df: DataFrame) -> DataFrame:
    return (df.where(F.col("Category").isNotNull()).groupBy("Category")
              .agg(F.round(F.avg("OrderValue"), 4).alias("avg_value"),
                   F.count(F.lit(1)).alias("n")))


def customer_table(df: DataFrame) -> DataFrame:
    """One row per shopper: Orders, AvgValue, AvgDiscount, PctCOD, ReturnRate."""
    return (df.where(F.col("CustomerID").isNotNull())
              .groupBy("CustomerID")
              .agg(F.count(F.lit(1)).alias("Orders"),
                   F.avg("OrderValue").alias("AvgValue"),
                   F.avg("DiscountPct").alias("AvgDiscount"),
                   F.avg("IsCOD").alias("PctCOD"),
                   F.avg("RTO").alias("ReturnRate")))


def distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level) for every distinct non-null level of each column: one pass over an
    unpivoted projection, then a distinct."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
                      for c in cols])
    return (df.select(F.inline(pairs)).where(F.col("level").isNotNull()).distinct())


def mode_of(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, the smallest one on ties (one row)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("n"), F.col(col))).alias("mode"),
                      F.max("n").alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max], the last bin closed: (bin, lo, hi, n).

    min/max come from one aggregate used as a scalar subquery; counting is a group-by on
    the bin number (at most ``bins`` groups)."""
    mm = df.agg(F.array(F.min(col).cast("double"), F.max(col).cast("double"))).scalar()
    lo, hi = mm[0], mm[1]
    x = F.col(col).cast("double")
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((x - lo) * F.lit(float(bins)) / width),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return (df.where(F.col(col).isNotNull())
              .select(b.alias("bin"))
              .groupBy("bin")
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("__lo", lo).withColumn("__hi", hi)
              .select("bin",
                      F.round(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("bin") / bins, 6)
                       .alias("lo"),
                      F.round(F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (F.col("bin") + 1) / bins, 6)
                       .alias("hi"),
                      "n"))


def validation_report(raw: DataFrame) -> DataFrame:
    """The generator-side check on the raw export: rows, shoppers, duplicate rows, and
    return rates overall / COD / prepaid after exact de-duplication. One aggregate over the
    raw rows and one over the de-duplicated rows (a scalar subquery)."""
    y = (F.col("DeliveryStatus") == "Returned").cast("int")
    d = raw.distinct().agg(F.struct(
        F.count(F.lit(1)).alias("distinct_rows"),
        F.round(F.avg(y), R6).alias("overall_rate"),
        F.round(F.avg(F.when(F.col("PaymentMethod") == "COD", y)), R6).alias("cod_rate"),
        F.round(F.avg(F.when(F.col("PaymentMethod") == "Prepaid", y)), R6).alias("prepaid_rate"))).scalar()
    n = raw.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("CustomerID").alias("shoppers"))
    return n.select("rows", "shoppers", (F.col("rows") - d["distinct_rows"]).alias("duplicates"),
                    d["overall_rate"].alias("overall_rate"), d["cod_rate"].alias("cod_rate"),
                    d["prepaid_rate"].alias("prepaid_rate"))
