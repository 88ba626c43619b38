"""Association of categorical clues with the return flag: contingency counts, Pearson
chi-square (with Yates' continuity correction on 2x2 tables, as SciPy applies it),
Cramer's V and the clue table.

All clues are unpivoted once and counted in a single ``groupBy(clue, level)`` with
map-side combine, so the shuffle carries (clue, level) partial counts, not rows. The
per-level table is bounded by the number of distinct levels, so the per-clue sums after
it are tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions.pvalue import chi2_pvalue

# The clues tested against returns, in the reference's order.
ASSOCIATION_CLUES = ["PaymentMethod", "CityTier", "Category", "AddressQuality", "State", "Device"]


def contingency(df: DataFrame, clues: Sequence[str], target: str = "RTO") -> DataFrame:
    """(clue, level, o0, o1): counts of target 0 / 1 per non-null level of each clue."""
    pairs = F.array(*[F.struct(F.lit(c).alias("clue"), F.col(c).cast("string").alias("level"))
                      for c in clues])
    return (df.select(F.col(target).alias("__y"), F.inline(pairs))
              .where(F.col("level").isNotNull() & F.col("__y").isNotNull())
              .groupBy("clue", "level")
              .agg(F.count_if(F.col("__y") == 0).alias("o0"),
                   F.count_if(F.col("__y") == 1).alias("o1")))


def chi_square(df: DataFrame, clues: Sequence[str] = ASSOCIATION_CLUES,
               target: str = "RTO", with_pvalue: bool = False) -> DataFrame:
    """Per clue: chi2, dof, n, n_levels, cramers_v (and p_value, real_link if asked)."""
    cells = contingency(df, clues, target)
    totals = cells.groupBy("clue").agg(
        F.sum("o0").alias("c0"), F.sum("o1").alias("c1"), F.count(F.lit(1)).alias("r"))
    k = (F.when(F.col("c0") > 0, 1).otherwise(0) + F.when(F.col("c1") > 0, 1).otherwise(0))
    j = (cells.join(totals, "clue")
              .withColumn("n", F.col("c0") + F.col("c1"))
              .withColumn("k", k)
              .withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1)))
    ni = F.col("o0") + F.col("o1")

    def term(o, c):
        e = ni * F.col(c) / F.col("n")
        diff = F.abs(F.col(o) - e)
        corr = F.when(F.col("dof") == 1, F.least(F.lit(0.5), diff)).otherwise(F.lit(0.0))
        return F.when(e > 0, F.pow(diff - corr, 2) / e).otherwise(F.lit(0.0))

    per = j.withColumn("__t", term("o0", "c0") + term("o1", "c1"))
    out = (per.groupBy("clue")
              .agg(F.when(F.first("dof") > 0, F.sum("__t")).otherwise(F.lit(0.0)).alias("chi2"),
                   F.first("dof").cast("int").alias("dof"),
                   F.first("n").cast("bigint").alias("n"),
                   F.first("r").cast("int").alias("n_levels"),
                   F.first("k").alias("__k")))
    denom = F.greatest(F.least(F.col("n_levels") - 1, F.col("__k") - 1), F.lit(1))
    out = out.withColumn("cramers_v", F.sqrt((F.col("chi2") / F.col("n")) / denom)).drop("__k")
    extra = []
    if with_pvalue:
        # one row per clue reaches the Python helper
        out = out.withColumn("__p", chi2_pvalue(F.col("chi2"), F.col("dof")))
        extra = [F.round("__p", 6).alias("p_value"), (F.col("__p") < 0.05).alias("real_link")]
    return out.select("clue", F.round("chi2", 6).alias("chi2"), "dof", "n", "n_levels",
                      F.round("cramers_v", 6).alias("cramers_v"), *extra)


def association_table(df: DataFrame, clues: Sequence[str] = ASSOCIATION_CLUES,
                      with_pvalue: bool = False) -> DataFrame:
    """The clue table: Cramer's V (3 decimals) per clue plus chi2 and dof; sorted by the
    caller (``orderBy(desc('cramers_v'), 'clue')``) when shown."""
    t = chi_square(df, clues, with_pvalue=with_pvalue)
    cols = ["clue", F.round("cramers_v", 3).alias("cramers_v_3"), "cramers_v", "chi2", "dof",
            "n_levels"]
    if with_pvalue:
        cols += ["p_value", "real_link"]
    return t.select(*cols)
