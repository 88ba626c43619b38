"""Order rows for the registered queries and tests, derived with Spark from the driver's tables.

The layout is the 16-column order export; rows come from orders, line items, parts, customers
and nations. Spellings, gaps and copies are dealt by remainders of the order key, and an order
is returned if a hashed percentage draw is below the sum of a few whole points (shopper
habit, tier, address, discount). ``orders_table_sql`` says the same in DuckDB SQL; FIXTURES.md
has the definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.exprs import hash_uniform
from parcelwise.operators.windows import prior_history
from parcelwise.sources.tables import read_table

EPOCH = "1995-01-01"
RAW_COLUMNS = ["OrderID", "CustomerID", "OrderDay", "CityTier", "State", "Category",
               "OrderValue", "DiscountPct", "PaymentMethod", "Device", "AddressQuality",
               "OrderHour", "Items", "PriorOrders", "PriorReturns", "DeliveryStatus"]


def order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order grain: orders joined to shopper, nation, line summary and lead part. The texts are
    joined last, so that the joins before move narrow rows."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderpriority") < F.lit("4")).alias("cod"), "o_totalprice",
        F.datediff(F.to_date("o_orderdate"), F.lit(EPOCH).cast("date")).alias("day"))
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    part = read_table(spark, sf_dir, "part")
    lines = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("items"), (F.min("l_discount") + F.max("l_discount")).alias("d2"),
                  F.min("l_partkey").alias("pk")))
    return (orders.join(lines, orders.o_orderkey == lines.l_orderkey)
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(part, F.col("pk") == part.p_partkey)
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey)
            .select("o_orderkey", "o_custkey", "o_orderstatus", "cod", "o_totalprice", "day", "items", "d2", "p_type",
                    "n_name", "n_regionkey"))


def _each(n: int, rest: int = 0) -> Column:
    return F.col("o_orderkey") % n == rest


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy export: one row per order, some twice. The shopper's history is counted on the
    narrow rows; the texts are made after it, so that no shuffle moves them."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    tier = F.when(F.col("n_regionkey") <= 1, 1).when(F.col("n_regionkey") <= 3, 2).otherwise(3)
    discount, cod = F.round(F.lit(300.0) * F.col("d2")).cast("int"), F.col("cod")
    status = F.col("o_orderstatus")

    habit = F.floor(F.lit(8) * hash_uniform(ck, "habit"))
    points = (F.lit(4) + 6 * habit + 3 * tier + F.when(status == "P", 9).when(status == "O", 4).otherwise(0)
              + F.floor(discount / F.lit(12)))
    chance = F.when(cod, points).otherwise(habit)
    returned = F.floor(F.lit(100) * hash_uniform(ok, "back")) < chance
    numbers = order_base(spark, sf_dir).select(
        "*", F.when(_each(97), F.lit(None)).otherwise(ck).cast("bigint").alias("shopper"),
        F.when(_each(131), F.lit(None)).otherwise(F.col("day")).cast("int").alias("OrderDay"),
        returned.cast("int").alias("__ret")).drop("o_custkey", "day")
    rows = prior_history(numbers, cust="shopper", day="OrderDay", seq="o_orderkey", flag="__ret")

    # Tier spellings and currency prefixes that the cleaner has to read.
    spelling = F.element_at(F.array(*map(F.lit, ("Tier-", "Tier ", "tier", "T", "TIER-"))), (ok % 5 + 1).cast("int"))
    prefix = F.element_at(F.array(*map(F.lit, ("", "Rs ", "INR ", "Rs."))), (ok % 4 + 1).cast("int"))
    name = F.col("n_name")
    amount = F.format_number(F.round(F.col("o_totalprice") / F.lit(33.0)).cast("bigint"), 0)
    percent = F.concat(discount.cast("string"), F.when(ok % 2 == 0, F.lit("%")).otherwise(F.lit("")))
    export = rows.select(
        F.concat(F.lit("ORD"), (ok + F.lit(100000)).cast("string")).alias("OrderID"),
        F.concat(F.lit("CUST"), (F.col("shopper") + F.lit(10000)).cast("string")).alias("CustomerID"), "OrderDay",
        F.when(_each(101), F.lit("rural")).otherwise(F.concat(spelling, tier.cast("string"))).alias("CityTier"),
        F.when(_each(73), none).when(ok % 6 == 0, F.upper(name)).when(ok % 6 == 1, F.lower(name))
         .when(ok % 6 == 2, F.concat(F.lit(" "), name, F.lit("  "))).otherwise(name).alias("State"),
        F.when(_each(61), F.lit("Unknown")).when(ok % 9 == 0, F.lit("Fashion")).when(ok % 9 == 1, F.lit("Electronics"))
         .otherwise(F.col("p_type")).alias("Category"),
        F.when(_each(157), F.lit("on request")).otherwise(F.concat(prefix, amount)).alias("OrderValue"),
        F.when(_each(53), none).when(_each(59), F.lit("free")).when(_each(307), F.lit("101%"))
         .when(_each(311), F.lit("250")).otherwise(percent).alias("DiscountPct"),
        F.when(cod, F.lit("COD")).otherwise(F.lit("Prepaid")).alias("PaymentMethod"),
        F.when(_each(23), none).when(ok % 3 == 0, F.lit("Phone")).when(ok % 3 == 1, F.lit("Tablet"))
         .otherwise(F.lit("Browser")).alias("Device"),
        F.when(_each(19), none).when(status == "F", F.lit("Complete")).when(status == "O", F.lit("Partial"))
         .when(status == "P", F.lit("Vague")).alias("AddressQuality"),
        (ok % 24).cast("int").alias("OrderHour"),
        F.col("items").cast("int").alias("Items"), "PriorOrders", "PriorReturns",
        F.when(F.col("__ret") == 1, F.lit("Returned")).otherwise(F.lit("Delivered")).alias("DeliveryStatus"),
        F.when(_each(211), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("__copies"))
    return export.withColumn("__copy", F.explode("__copies")).select(*RAW_COLUMNS)


def rule_scored(cod: DataFrame) -> DataFrame:
    """A rule score over cleaned COD orders, so that metric and policy queries can be checked
    exactly: Risk in (0, 1) and Score = half-even round of 900 - 600 * Risk. An order without
    a tier or a discount is not scored (NULL)."""
    history = (F.col("PriorReturns") + 1.0) / (F.col("PriorOrders") + 3.0)
    tier = F.substring("CityTier", 6, 1).try_cast("int")
    address = F.when(F.col("AddressQuality") == "Complete", 0.0).when(F.col("AddressQuality") == "Vague", 0.1).otherwise(0.05)
    risk = F.lit(0.04) + F.lit(0.55) * history + F.lit(0.03) * tier + address + F.col("DiscountPct") / F.lit(400.0)
    risk = F.when(risk.isNotNull(), F.least(F.lit(0.97), risk))
    return cod.withColumn("Risk", risk).withColumn(
        "Score", F.bround(F.lit(900.0) - F.lit(600.0) * F.col("Risk"), 0).cast("int"))
