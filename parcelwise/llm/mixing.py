"""Mixing sources to target weights (DataFrame functions only).

Sizes are summed per source, a target is derived for each source, and every document of a
source with rate ``target / size`` is taken ``floor(rate)`` times plus one more time with
probability ``rate - floor(rate)``, drawn from a hash of its id and the seed.

Targets: a budget (a share of all sizes) is dealt by weight; no target exceeds ``max_rate``
times its source's size, and the excess is dealt again by weight among the others until none
exceeds its limit.

Defined cases: a null or empty text has size 0; a null source is a source of its own, after
all others; a null doc_id draws as one id of its own; rows that repeat a doc_id draw alike,
each row counts; a source of size 0 has target 0; empty input gives no rows. Columns of the
input are kept, new ones get names that do not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import WORD, columns_of, ranked
from parcelwise.sources.scratch import Scratch

SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A uniform in [0, 1) from the id and the seed (52 bits of an md5)."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("none")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cycle_weights(sizes: DataFrame, weights: list[int], scratch: Scratch) -> DataFrame:
    """Sources in code point order (null last) get the weights in turn."""
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    return ranked(sizes, order, scratch, "place").withColumn("weight", weight).drop("place")


def source_targets(sizes: DataFrame, share: float, max_rate: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, weight) with ``target``. One small aggregate per dealing."""
    sizes = scratch.table(sizes, "sources")
    total = sizes.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    budget, level = share * (total["t"] or 0), None
    limit = F.col("source_size") * F.lit(float(max_rate))
    new = budget / total["w"] if total["w"] else 0.0
    while new != level:
        level = new
        full = F.col("weight") * F.lit(level) > limit
        row = sizes.agg(F.sum(F.when(full, limit).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        new = (budget - row["fixed"]) / row["open"]
    return sizes.withColumn("target", F.least(F.col("weight") * F.lit(float(level)), limit))


def copies(target: Column, source_size: Column, doc_id: Column, seed: str) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id, seed) < rate - whole, 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, weights: list[int], share: float = 1.5, max_rate: float = 2.0,
             seed: str = SEED) -> DataFrame:
    """Per document: source, size, source_size, weight, target, copies."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = columns_of(docs, "doc_id", "source", "text")
    sized = scratch.table(rows.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(cycle_weights(sums, weights, scratch), share, max_rate, scratch)
    targets = targets.withColumnRenamed("source", "of_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    return joined.withColumn("copies", copies(F.col("target"), F.col("source_size"), F.col("doc_id"), seed))


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, max_rate: float = 2.0,
        seed: str = SEED) -> DataFrame:
    """The documents of the mix themselves: each row as often as the plan takes it."""
    scratch = Scratch(docs.sparkSession, "mixing")
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "source", "text")}
    rows = docs.toDF(*names)
    sums = rows.groupBy(place["source"].alias("source")).agg(F.sum(word_count(place["text"])).alias("source_size"))
    targets = source_targets(cycle_weights(sums, weights, scratch), share, max_rate, scratch)
    joined = rows.join(targets, place["source"].eqNullSafe(F.col("source")))
    times = copies(F.col("target"), F.col("source_size"), place["doc_id"], seed)
    taken = joined.withColumn("times", times).where("times > 0")
    out = taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy_no"))
    return out.select(*names).toDF(*docs.columns)
