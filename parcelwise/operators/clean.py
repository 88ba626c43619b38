"""Cleaning of the messy order export, one step per function, plus an audit table.

Reference order of steps: exact de-duplication first (so copies that differ only in
spelling survive), then currency / percent parsing, capping impossible discounts at the
median of the valid ones, tier and state normalisation, 'Unknown' fills, derived flags,
and finally dropping rows whose order value could not be parsed.

Scale notes: de-duplication counts row hashes with map-side combine and compares whole rows
only where a hash comes twice, so distinct rows are not shuffled and even a row copied a billion
times collapses before the shuffle. The median is an exact
``percentile`` whose partial state is a value->count map (discounts are small integers, so
the map stays tiny); it enters the row expression as a scalar subquery, never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.functions import exprs as X
from parcelwise.sources.io import MissingColumnsError
from parcelwise.sources.scratch import Scratch

REQUIRED_COLUMNS = ["DeliveryStatus", "PriorOrders", "PriorReturns", "PaymentMethod"]
OPTIONAL_COLUMNS = ["OrderValue", "DiscountPct", "CityTier", "State", "Device", "AddressQuality"]

#: Rows up to which copies are removed by one plain aggregate, and row hashes (8 bytes) that are broadcast.
PLAIN_ROWS, MOST_KEYS = 500_000, 1 << 21


def schema_guard(df: DataFrame) -> DataFrame:
    """Fail early, with the column names, when a required column is absent."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"order table lacks required columns: {missing}")
    return df


def dedup(df: DataFrame, plain_rows: int = PLAIN_ROWS, most_keys: int = MOST_KEYS) -> DataFrame:
    """The distinct rows. In a written table of more than ``plain_rows`` rows, row hashes are
    counted first, and only rows that share theirs with another are compared (all columns); the others are
    distinct as they are. With more than ``most_keys`` shared hashes all rows are compared."""
    if getattr(df, "scratch_path", None) is None or df.count() <= plain_rows:
        return df.dropDuplicates()
    keyed = df.withColumn("__hash", F.xxhash64(*df.columns))
    shared = keyed.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("__hash")
    shared = Scratch(df.sparkSession, "dedup").table(shared, "shared")
    if shared.count() > most_keys:
        return df.dropDuplicates()
    alike = keyed.join(F.broadcast(shared), "__hash", "left_semi").drop("__hash").dropDuplicates()
    return keyed.join(F.broadcast(shared), "__hash", "left_anti").drop("__hash").unionByName(alike)


def parse_value(df: DataFrame, parity: bool = False) -> DataFrame:
    if "OrderValue" not in df.columns:
        return df
    return df.withColumn("OrderValue", X.parse_currency("OrderValue", parity=parity))


def parse_discount(df: DataFrame) -> DataFrame:
    if "DiscountPct" not in df.columns:
        return df
    return df.withColumn("DiscountPct", X.parse_percent("DiscountPct"))


def discount_median(df: DataFrame, limit: float = 100.0) -> DataFrame:
    """One-row frame: exact (interpolated) median of valid discounts (<= limit)."""
    return (df.where(F.col("DiscountPct") <= limit)
              .agg(F.median("DiscountPct").alias("__disc_median")))


def cap_discount(df: DataFrame, limit: float = 100.0) -> DataFrame:
    """Discounts above ``limit`` become the median of discounts at or below it."""
    if "DiscountPct" not in df.columns:
        return df
    med = discount_median(df, limit).scalar()  # scalar subquery, evaluated once
    return df.withColumn("DiscountPct",
                         F.when(F.col("DiscountPct") > limit, med).otherwise(F.col("DiscountPct")))


def clip_discount(df: DataFrame, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Variant rule: clip discounts into [lo, hi]."""
    return df.withColumn("DiscountPct", F.greatest(F.least(F.col("DiscountPct"), F.lit(hi)),
                                                   F.lit(lo)))


def normalise_tier(df: DataFrame) -> DataFrame:
    if "CityTier" not in df.columns:
        return df
    return df.withColumn("CityTier", X.tier_label("CityTier"))


def normalise_state(df: DataFrame) -> DataFrame:
    if "State" not in df.columns:
        return df
    return df.withColumn("State", X.clean_state("State"))


def fill_unknown(df: DataFrame, cols=("Device", "AddressQuality")) -> DataFrame:
    present = {c: "Unknown" for c in cols if c in df.columns}
    return df.na.fill(present) if present else df


def add_flags(df: DataFrame) -> DataFrame:
    """RTO target and pre-dispatch features: PriorRTORate, FirstTime, IsCOD."""
    po, pr = F.col("PriorOrders"), F.col("PriorReturns")
    return (df
            .withColumn("RTO", F.coalesce((F.col("DeliveryStatus") == "Returned").cast("int"),
                                          F.lit(0)))
            .withColumn("PriorRTORate", F.when(po > 0, pr / po).otherwise(F.lit(0.0)))
            .withColumn("FirstTime", (po == 0).cast("int"))
            .withColumn("IsCOD", F.coalesce((F.col("PaymentMethod") == "COD").cast("int"),
                                            F.lit(0))))


def drop_null_value(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["OrderValue"])


def clean_orders(raw: DataFrame, parity: bool = False, dedup_after: bool = False) -> DataFrame:
    """The whole cleaning pipeline (reference step order unless ``dedup_after``)."""
    df = schema_guard(raw)
    if not dedup_after:
        df = dedup(df)
    df = (df.transform(lambda d: parse_value(d, parity))
            .transform(parse_discount)
            .transform(cap_discount)
            .transform(normalise_tier)
            .transform(normalise_state)
            .transform(fill_unknown))
    if dedup_after:
        df = dedup(df)
    return df.transform(add_flags).transform(drop_null_value)


def audit(raw: DataFrame) -> DataFrame:
    """The cleaning log as a table: (step, metric, before, after).

    The de-duplicated rows are written once; the raw rows are read once more, for their
    number and the table of tier and state spellings, from which distinct values are counted.
    """
    scratch = Scratch(raw.sparkSession, "audit")
    levels = scratch.table(raw.groupBy("CityTier", "State").agg(F.count(F.lit(1)).alias("n")), "levels")
    nr = levels.agg(F.struct(F.sum("n").alias("n"), F.countDistinct("CityTier").alias("tiers"),
                             F.countDistinct("State").alias("states"),
                             F.countDistinct(X.tier_label("CityTier")).alias("tiers_after"),
                             F.countDistinct(X.clean_state("State")).alias("states_after"))).scalar()
    parsed = scratch.table(dedup(raw), "distinct").transform(parse_value).transform(parse_discount)
    s1 = parsed.agg(
        F.count(F.lit(1)).alias("n_dedup"),
        F.count_if(F.col("OrderValue").isNull()).alias("value_null"),
        F.count_if(F.col("DiscountPct").isNull()).alias("disc_null"),
        F.count_if(F.col("DiscountPct") > 100).alias("disc_bad"),
        F.median(F.when(F.col("DiscountPct") <= 100, F.col("DiscountPct"))).alias("disc_median"),
        F.count_if(X.tier_label("CityTier").isNull()).alias("tier_null"),
        F.count_if(F.col("Device").isNull()).alias("device_null"),
        F.count_if(F.col("AddressQuality").isNull()).alias("address_null"),
    )
    # copies that differ only in spelling: distinct rows once tier/state/fills are normalised,
    # told apart by two hashes instead of all their columns
    normalised = parsed.transform(normalise_tier).transform(normalise_state).transform(fill_unknown)
    hashed = normalised.select(F.xxhash64(*normalised.columns).alias("one"),
                               F.xxhash64(F.lit(1), *normalised.columns).alias("two")).distinct()
    n_norm = hashed.agg(F.count(F.lit(1))).scalar()
    both = s1.select(*[nr[c].alias(c) for c in ("n", "tiers", "states", "tiers_after", "states_after")], *s1.columns)

    def row(step, metric, before, after):
        return F.struct(F.lit(step).alias("step"), F.lit(metric).alias("metric"),
                        before.cast("double").alias("before"), after.cast("double").alias("after"))

    c = F.col
    entries = F.array(
        row("dedup", "rows", c("n"), c("n_dedup")),
        row("dedup", "duplicates_removed", F.lit(0), c("n") - c("n_dedup")),
        row("dedup", "more_copies_if_normalised_first", F.lit(0), c("n_dedup") - n_norm),
        row("order_value", "unparsable", F.lit(0), c("value_null")),
        row("discount", "unparsable", F.lit(0), c("disc_null")),
        row("discount", "above_100_set_to_median", c("disc_bad"), F.lit(0)),
        row("discount", "median_used", c("disc_median"), c("disc_median")),
        row("city_tier", "distinct_values", c("tiers"), c("tiers_after")),
        row("city_tier", "unrecognised", F.lit(0), c("tier_null")),
        row("state", "distinct_values", c("states"), c("states_after")),
        row("device", "missing_to_unknown", c("device_null"), F.lit(0)),
        row("address_quality", "missing_to_unknown", c("address_null"), F.lit(0)),
        row("drop_null_value", "rows", c("n_dedup"), c("n_dedup") - c("value_null")),
    )
    return both.select(F.inline(entries))
