"""Trait-combination rules for returns.

Each COD order becomes a basket of seven trait items (tier, category, address, device,
discount band, first-timer/repeat, outcome). Every order carries exactly one item per trait,
so an itemset is a choice of values for a subset of traits and itemset counts are a
``GROUP BY CUBE``. Orders are first pre-aggregated to the full trait detail, so the cube expands
a table bounded by the product of level counts, not the order table. Itemsets, single-item
rules and the rules for returns all come from it (tests compare them with FP-growth).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import exprs as X

# Item texts of the basket traits.
TRAITS = ["tier", "cat", "addr", "dev", "disc", "first"]
OUTCOME_ITEMS = ("RETURNED", "delivered")
DISC_BASKET_LABELS = ["disc 0-10%", "disc 11-25%", "disc 26-40%", "disc 40%+"]


def basket_traits(cod: DataFrame) -> DataFrame:
    """OrderID, the six trait items and the outcome item (never NULL: a missing trait
    value becomes an explicit 'unknown' item so it cannot look like a rolled-up one). Category
    and device items carry their trait's name, so that equal values of two traits (a category
    and a device both 'Unknown') stay two items."""
    disc = X.cut("DiscountPct", X.DISCOUNT_EDGES, DISC_BASKET_LABELS)
    return cod.select(
        "OrderID",
        F.coalesce(F.col("CityTier"), F.lit("Tier unknown")).alias("tier"),
        F.concat(F.lit("cat "), F.coalesce(F.col("Category"), F.lit("unknown"))).alias("cat"),
        F.concat(F.coalesce(F.col("AddressQuality"), F.lit("Unknown")), F.lit(" address")).alias("addr"),
        F.concat(F.lit("dev "), F.coalesce(F.col("Device"), F.lit("Unknown"))).alias("dev"),
        F.coalesce(disc, F.lit("disc unknown")).alias("disc"),
        F.when(F.col("FirstTime") == 1, F.lit("first-timer")).otherwise(F.lit("repeat buyer")).alias("first"),
        F.when(F.col("RTO") == 1, F.lit(OUTCOME_ITEMS[0])).otherwise(F.lit(OUTCOME_ITEMS[1])).alias("out"),
    )


def baskets(cod: DataFrame) -> DataFrame:
    """OrderID, items: array<string> of the seven items."""
    t = basket_traits(cod)
    return t.select("OrderID", F.array(*[F.col(c) for c in TRAITS + ["out"]]).alias("items"))


def rules_cube(cod: DataFrame, min_support: float = 0.02, min_lift: float = 1.0,
               min_antecedents: int = 2) -> DataFrame:
    """Rules {A} -> {RETURNED} with support(A + RETURNED) >= min_support,
    lift >= min_lift and |A| >= min_antecedents.

    Output: combo (sorted items joined by ' + '), n_antecedents, support, confidence,
    lift (6 decimals)."""
    t = basket_traits(cod).withColumn("__r", (F.col("out") == OUTCOME_ITEMS[0]).cast("int"))
    detail = t.groupBy(*TRAITS).agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("r"))
    n_all = detail.agg(F.sum("n")).scalar()
    r_all = detail.agg(F.sum("r")).scalar()
    cube = detail.cube(*TRAITS).agg(F.sum("n").alias("nA"), F.sum("r").alias("rA"),
                                    F.grouping_id().alias("gid"))
    # a set bit in grouping_id marks a rolled-up trait (first trait = highest bit)
    present = [F.when(((F.col("gid").bitwiseAND(1 << (len(TRAITS) - 1 - i))) == 0), F.col(c))
               for i, c in enumerate(TRAITS)]
    items = F.array_compact(F.array(*present))
    r = (cube.withColumn("N", n_all).withColumn("R", r_all)
             .withColumn("__items", items)
             .withColumn("n_antecedents", F.size("__items"))
             .withColumn("support", F.col("rA") / F.col("N"))
             .withColumn("confidence", F.col("rA") / F.col("nA"))
             .withColumn("lift", F.col("confidence") / (F.col("R") / F.col("N"))))
    r = r.where((F.col("n_antecedents") >= min_antecedents)
                & (F.col("support") >= min_support) & (F.col("lift") >= min_lift))
    return r.select(F.array_join(F.array_sort("__items"), " + ").alias("combo"),
                    "n_antecedents",
                    F.round("support", 6).alias("support"),
                    F.round("confidence", 6).alias("confidence"),
                    F.round("lift", 6).alias("lift"))


def itemset_counts(cod: DataFrame, min_support: float = 0.02) -> DataFrame:
    """Frequent itemsets over all seven traits (outcome included): items (sorted array), freq.

    An order has one item per trait, so the itemsets are the cells of a cube over the
    pre-aggregated seven-trait detail; its size depends on the levels, not on the orders."""
    traits = [*TRAITS, "out"]
    detail = basket_traits(cod).groupBy(*traits).agg(F.count(F.lit(1)).alias("n"))
    cube = detail.cube(*traits).agg(F.sum("n").alias("freq"), F.grouping_id().alias("gid"))
    present = [F.when(F.col("gid").bitwiseAND(1 << (len(traits) - 1 - i)) == 0, F.col(c))
               for i, c in enumerate(traits)]
    cells = cube.select(F.array_sort(F.array_compact(F.array(*present))).alias("items"), "freq")
    least = F.ceil(detail.agg(F.sum("n")).scalar() * F.lit(float(min_support)) - F.lit(1e-9))
    return cells.withColumn("least", least).where((F.size("items") > 0) & (F.col("freq") >= F.col("least"))) \
        .select("items", "freq")


def frequent_itemsets(cod: DataFrame, min_support: float = 0.02) -> DataFrame:
    """itemset (sorted items joined by ' + '), size, freq."""
    return itemset_counts(cod, min_support).select(
        F.array_join("items", " + ").alias("itemset"), F.size("items").alias("size"),
        F.col("freq").cast("bigint").alias("freq"))


def association_rules(cod: DataFrame, min_support: float = 0.02, min_lift: float = 1.0) -> DataFrame:
    """Rules with one consequent item: antecedent (sorted array), consequent, support,
    confidence, lift (not rounded). Both sides of a rule are frequent, so their counts are
    looked up in the itemset table itself."""
    sets = itemset_counts(cod, min_support)
    n_all = basket_traits(cod).agg(F.count(F.lit(1))).scalar()
    whole = sets.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("consequent"))
    whole = whole.withColumn("antecedent", F.array_remove("items", F.col("consequent")))
    sides = sets.select(F.array_join("items", " + ").alias("key"), F.col("freq").alias("key_freq"))
    left = sides.withColumnsRenamed({"key": "a_key", "key_freq": "a_freq"})
    right = sides.withColumnsRenamed({"key": "c_key", "key_freq": "c_freq"})
    rules = whole.withColumn("a_key", F.array_join("antecedent", " + ")).join(left, "a_key") \
        .join(right, F.col("consequent") == F.col("c_key")).withColumn("all", n_all)
    confidence = F.col("freq") / F.col("a_freq")
    return rules.select(
        "antecedent", "consequent", (F.col("freq") / F.col("all")).alias("support"), confidence.alias("confidence"),
        (confidence / (F.col("c_freq") / F.col("all"))).alias("lift")).where(F.col("lift") >= min_lift)


def _shown(rules: DataFrame, *columns) -> DataFrame:
    return rules.select(*columns, *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


def rules_lift(cod: DataFrame, min_support: float = 0.02, min_lift: float = 1.0) -> DataFrame:
    """All single-consequent rules with lift >= min_lift (6-decimal metrics)."""
    return _shown(association_rules(cod, min_support, min_lift),
                  F.array_join("antecedent", " + ").alias("antecedent"), "consequent")


def rules_returned(cod: DataFrame, min_support: float = 0.02, min_lift: float = 1.0,
                   min_antecedents: int = 2) -> DataFrame:
    """The {A} -> {RETURNED} rules, same layout as :func:`rules_cube`."""
    rules = association_rules(cod, min_support, min_lift)
    rules = rules.where((F.col("consequent") == OUTCOME_ITEMS[0]) & (F.size("antecedent") >= min_antecedents))
    return _shown(rules, F.array_join("antecedent", " + ").alias("combo"), F.size("antecedent").alias("n_antecedents"))


def format_rules(rules: DataFrame) -> DataFrame:
    """Display text: support as '4.2%', confidence as '57%', lift to 2 decimals."""
    return rules.select(
        "combo",
        F.concat(F.format_number(F.col("support") * 100, 1), F.lit("%")).alias("how_common"),
        F.concat(F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"),
                 F.lit("%")).alias("return_follows"),
        F.round("lift", 2).alias("times_riskier"),
        "lift",
    )
