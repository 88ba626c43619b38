"""Decision trees with exact split thresholds, grown level by level as grouped aggregates.

Numbers are filled, levels coded and rows packed into blocks once: a block holds each column's distinct
values and the places of its rows in them, as bytes. Per level, tasks find the node of each row, count a
block per (node, column, value) as arrays, and one aggregate merges what the blocks hold: rows are
never multiplied by columns. Running sums over a column's distinct values give both sides of every possible
cut; they run inside value ranges, with range offsets from a table of one row per range, so that
no task holds all values of a column. A number is cut halfway between two neighbouring values of
the node; a category is cut into one level and the rest. Only each node's best cut reaches the
driver (at most 2^depth rows), and the tree so far becomes a column expression.

Two measures: ``gini`` on class-weighted counts and ``squares`` on sums of the target. Counts are
whole numbers and the target is summed as whole ten-thousandths (in two parts that sum up exactly),
so results do not depend on partitions. Equal
scores go to the first column, then to the smaller threshold or level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.operators.encoding import SCHEMA as ENCODING
from parcelwise.operators.encoding import Encoding
from parcelwise.sources.scratch import Scratch

RANGE_ROWS = 1_000_000
#: Rows of a block at most. A part of a target is below 2^35, so its sums over a block are exact as doubles.
BLOCK_ROWS = 1 << 16
#: A target in ten-thousandths is high * PART + low.
PART = 1 << 32


@dataclass
class Split:
    column: int
    threshold: float | None
    level: str | None


@dataclass
class Tree:
    """Nodes numbered from 1, children of i: 2i (left) and 2i + 1. ``leaves`` has each node's
    (a, b): class counts, or the number of rows and the sum of the target."""

    encoding: Encoding
    splits: dict[int, Split] = field(default_factory=dict)
    leaves: dict[int, tuple[float, float]] = field(default_factory=dict)

    def right(self, node: int) -> Column:
        s, n_num = self.splits[node], len(self.encoding.num)
        if s.column < n_num:
            c = self.encoding.num[s.column]
            return F.coalesce(F.col(c).cast("double"), F.lit(self.encoding.medians[s.column])) > F.lit(s.threshold)
        return F.col(self.encoding.cat[s.column - n_num]).eqNullSafe(F.lit(s.level))

    def choose(self, value, node: int = 1) -> Column:
        """``value(leaf)`` of the leaf that a row reaches."""
        if node not in self.splits:
            return value(node)
        return F.when(self.right(node), self.choose(value, 2 * node + 1)).otherwise(self.choose(value, 2 * node))

    def reach(self, inputs: Sequence[np.ndarray]) -> np.ndarray:
        """The nodes that rows reach, from their filled numbers and level codes."""
        n_num = len(self.encoding.num)
        out = np.ones(len(inputs[0]), dtype=np.int64)
        for node in sorted(self.splits):  # parents first
            s = self.splits[node]
            mine = np.flatnonzero(out == node)
            x = inputs[s.column][mine]
            if s.column < n_num:  # NaN is the largest number, as in SQL
                right = (x > s.threshold) | (np.isnan(x) & ~np.isnan(s.threshold))
            else:
                right = x == self.encoding.levels[s.column - n_num].index(s.level)
            out[mine] = 2 * node + right
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per node (bounded by the depth) with the encoding."""
        rows = []
        for node, (a, b) in sorted(self.leaves.items()):
            s = self.splits.get(node)
            rows.append((node, float(a), float(b), s and s.column, s and s.threshold, s and s.level, *self.encoding.row()))
        schema = f"node int, a double, b double, column int, threshold double, level string, {ENCODING}"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Tree:
        rows = spark.read.parquet(path).collect()
        splits = {r["node"]: Split(r["column"], r["threshold"], r["level"]) for r in rows if r["column"] is not None}
        return Tree(Encoding.of(rows[0]), splits, {r["node"]: (r["a"], r["b"]) for r in rows})

    def leaf(self) -> Column:
        return self.choose(F.lit)

    def rules(self) -> list[str]:
        """The tree as text, one line per node."""
        out = []
        for node in sorted(self.leaves):
            if node in self.splits:
                s, n_num = self.splits[node], len(self.encoding.num)
                name = (self.encoding.num + self.encoding.cat)[s.column]
                cut = f"{name} > {s.threshold:g}" if s.column < n_num else f"{name} = {s.level}"
                out.append(f"{node}: {cut} ? {2 * node + 1} : {2 * node}")
        return out


def _score(measure: str, weights: tuple[float, float], a: str, b: str) -> Column:
    """How well rows with the sums (a, b) hold together; a cut is worth the sum of both sides."""
    if measure == "gini":
        x, y = F.col(a).cast("double") * F.lit(weights[0]), F.col(b).cast("double") * F.lit(weights[1])
        return (x * x + y * y) / (x + y)
    s = F.col(b).cast("double")
    return s * s / F.col(a).cast("double")


def _stats(target: str, measure: str) -> list[Column]:
    """What is summed, as whole numbers: both classes' rows, or rows and the two parts of the target."""
    if measure == "gini":
        return [(F.col(target) == k).cast("long") for k in (0, 1)]
    y = (F.col(target).cast("decimal(20,4)") * F.lit(10_000)).cast("decimal(20,0)")
    part = F.lit(PART).cast("decimal(20,0)")
    low = y % part
    return [F.lit(1).cast("long"), low.cast("long"), ((y - low) / part).cast("long")]


def _summed(measure: str) -> list[Column]:
    """The sums (a, b) of the columns s0, s1, ... of ``_stats``."""
    sums = [F.sum(f"s{i}") for i in range(2 if measure == "gini" else 3)]
    if measure == "gini":
        return [sums[0].alias("a"), sums[1].alias("b")]
    low, high = (x.cast("decimal(20,0)") for x in sums[1:])
    total = (high * F.lit(PART).cast("decimal(10,0)") + low) * F.lit(Decimal("0.0001"))
    return [sums[0].alias("a"), total.cast("decimal(30,4)").alias("b")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, at most ``BLOCK_ROWS`` at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(at, BLOCK_ROWS)
            if n + piece.num_rows > BLOCK_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(piece)
            n += piece.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _packed(coded: DataFrame) -> DataFrame:
    """Blocks of rows: per column its distinct values and every row's place in them, as bytes."""
    names = [f"{kind}_{c}" for c in coded.columns for kind in ("values", "places")]

    def run(batches):
        for chunk in _chunks(batches):
            cells = [chunk.num_rows]
            for column in chunk.columns:
                found = column.combine_chunks().dictionary_encode()
                places = found.indices.to_numpy().astype(np.min_scalar_type(len(found.dictionary)))
                cells += [found.dictionary.to_numpy(zero_copy_only=False).tobytes(), places.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in cells], names=["n", *names])
    return coded.mapInArrow(run, "n long, " + ", ".join(f"{c} binary" for c in names))


def _cells(packed: DataFrame, tree: Tree, level: int, n_stats: int) -> DataFrame:
    """The sums of a block per (node, col, v, lev), for nodes of a level."""
    enc = tree.encoding
    n_num, width, first = len(enc.num), len(enc.num) + len(enc.cat), 1 << level
    stats = [f"s{i}" for i in range(n_stats)]
    names = [pa.array(known, pa.string()) for known in enc.levels]
    kinds = ["f8"] * n_num + ["i4"] * len(enc.cat) + ["i8"] * n_stats

    def run(batches):
        for batch in batches:
            for n, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                known = [np.frombuffer(x, kind) for x, kind in zip(cells[::2], kinds)]
                code = [np.frombuffer(x, f"u{len(x) // n}") for x in cells[1::2]]
                node = tree.reach([k[c] for k, c in zip(known[:width], code)])
                here = np.flatnonzero(node >= first)
                place, sums = node[here] - first, [k[c[here]] for k, c in zip(known[width:], code[width:])]
                if not len(here):
                    continue
                for j in range(width):
                    size = len(known[j])
                    key = place * size + code[j][here]
                    if first * size > 4 * len(here):  # more places than rows
                        found, key = np.unique(key, return_inverse=True)
                        some = np.arange(len(found))
                    else:
                        some = found = np.flatnonzero(np.bincount(key))
                    values = known[j][found % size]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(found // size + first, pa.int32()), pa.array(np.full(len(found), j), pa.int32()),
                        pa.array(values) if j < n_num else pa.nulls(len(found), pa.float64()),
                        pa.nulls(len(found), pa.string()) if j < n_num
                        else names[j - n_num].take(pa.array(values, mask=values < 0)),
                        *[pa.array(np.bincount(key, x)[some].astype(np.int64)) for x in sums]],
                        names=["node", "col", "v", "lev", *stats])
    return packed.mapInArrow(run, "node int, col int, v double, lev string, " + ", ".join(f"{c} long" for c in stats))


def _ranges(rows: DataFrame, enc: Encoding, range_rows: int) -> Column:
    """The value range of a (col, v): cuts at approximate quantiles, only to deal the work."""
    parts = min(max(1, -(-rows.count() // range_rows)), 10_000)
    if parts == 1 or not enc.num:
        return F.lit(0)
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.agg(*[F.percentile_approx(f"x{j}", shares, 20 * parts).alias(f"q{j}")
                      for j in range(len(enc.num))]).first()
    out = F.lit(0)
    for j in range(len(enc.num)):
        known = sorted(set(cuts[j] or []))
        place = F.lit(0)
        if known:  # binary search: width_bucket over an array of bounds is not at hand, so a sorted union
            at = F.array_sort(F.array_union(F.array(*[F.lit(x) for x in known]), F.array(F.col("v"))))
            place = F.array_position(at, F.col("v")).cast("int")
        out = F.when(F.col("col") == j, place).otherwise(out)
    return out


def _best_cuts(packed: DataFrame, tree: Tree, measure: str, weights, level: int, ranges: Column, scratch: Scratch) -> list:
    """The best cut of every node of a level: node, col, threshold, level, and the left side's sums."""
    n_num = len(tree.encoding.num)
    n_stats = 2 if measure == "gini" else 3
    counted = _cells(packed, tree, level, n_stats).groupBy("node", "col", "v", "lev").agg(*_summed(measure)) \
        .withColumn("rng", F.when(F.col("col") < n_num, ranges).otherwise(F.lit(0)))
    counted = scratch.table(counted, f"values_{level}")
    each = Window.partitionBy("node", "col")  # one row per range
    parts = counted.groupBy("node", "col", "rng").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"), F.min("v").alias("lo"))
    before = each.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("node", "col", "rng", F.sum("pa").over(each).alias("ta"), F.sum("pb").over(each).alias("tb"),
                         F.sum("pa").over(before).alias("ba"), F.sum("pb").over(before).alias("bb"),
                         F.lead("lo").over(each.orderBy("rng")).alias("next_lo"))
    numbers = counted.where(F.col("col") < n_num).join(parts, ["node", "col", "rng"])
    inside = Window.partitionBy("node", "col", "rng").orderBy("v")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.coalesce(F.lead("v").over(inside), F.col("next_lo"))
    cuts = numbers.select("node", "col", ((F.col("v") + following) / 2).alias("threshold"), F.lit(None).cast("string").alias("lev"),
                          (F.sum("a").over(run) + F.coalesce("ba", F.lit(0))).alias("la"),
                          (F.sum("b").over(run) + F.coalesce("bb", F.lit(0))).alias("lb"), "ta", "tb")
    cuts = cuts.where(F.col("threshold").isNotNull())
    levels = counted.where((F.col("col") >= n_num) & F.col("lev").isNotNull()).join(parts, ["node", "col", "rng"])
    levels = levels.select("node", "col", F.lit(None).cast("double").alias("threshold"), "lev", (F.col("ta") - F.col("a")).alias("la"),
                           (F.col("tb") - F.col("b")).alias("lb"), "ta", "tb")
    every = cuts.unionByName(levels).withColumn("ra", F.col("ta") - F.col("la")).withColumn("rb", F.col("tb") - F.col("lb"))
    if measure == "gini":
        every = every.where((F.col("ta") > 0) & (F.col("tb") > 0) & (F.col("la") + F.col("lb") > 0) & (F.col("ra") + F.col("rb") > 0))
    else:
        every = every.where((F.col("la") > 0) & (F.col("ra") > 0))
    every = every.withColumn("score", _score(measure, weights, "la", "lb") + _score(measure, weights, "ra", "rb"))
    best = every.groupBy("node").agg(F.min_by(
        F.struct("col", "threshold", "lev", "la", "lb", "ta", "tb"),
        F.struct(-F.col("score"), "col", F.coalesce("threshold", F.lit(0.0)), F.coalesce("lev", F.lit("")))).alias("best"))
    return best.select("node", "best.*").collect()  # at most 2^level rows


def grow(train: DataFrame, num: Sequence[str], cat: Sequence[str], target: str, measure: str = "gini", depth: int = 6,
         balanced: bool = True, range_rows: int = RANGE_ROWS) -> Tree:
    """A tree on ``train``. ``gini``: ``target`` is 0 or 1, classes weigh n / (2 n_class) if
    ``balanced``; a node of one class is a leaf. ``squares``: ``target`` is a number."""
    scratch = Scratch(train.sparkSession, "tree")
    rows = train.where(F.col(target).isNotNull()).select(*num, *cat, target)
    tree = Tree(Encoding.fit(rows, num, cat))
    stats = [c.alias(f"s{i}") for i, c in enumerate(_stats(target, measure))]
    coded = rows.select(*tree.encoding.numbers(), *tree.encoding.codes(), *stats)
    packed = scratch.table(_packed(coded), "rows")
    whole = coded.agg(*[F.coalesce(c, F.lit(0)) for c in _summed(measure)]).first()
    tree.leaves[1] = (whole[0], whole[1])
    weights = class_weights(tree) if balanced else (1.0, 1.0)
    ranges = _ranges(coded, tree.encoding, range_rows)
    for level in range(depth):
        found = _best_cuts(packed, tree, measure, weights, level, ranges, scratch)
        for r in found:
            tree.splits[r["node"]] = Split(r["col"], r["threshold"], r["lev"])
            tree.leaves[2 * r["node"]] = (r["la"], r["lb"])
            tree.leaves[2 * r["node"] + 1] = (r["ta"] - r["la"], r["tb"] - r["lb"])
        if not found:
            break
    return tree


def class_weights(tree: Tree) -> tuple[float, float]:
    n0, n1 = (float(x) for x in tree.leaves[1])
    return tuple((n0 + n1) / (2.0 * n) if n else 1.0 for n in (n0, n1))


def risk(tree: Tree, balanced: bool = True) -> Column:
    """The weighted share of class 1 in a row's leaf."""
    w0, w1 = class_weights(tree) if balanced else (1.0, 1.0)

    def share(node: int) -> Column:
        a, b = (float(x) for x in tree.leaves[node])
        return F.lit(b * w1 / (a * w0 + b * w1) if a + b else 0.5)
    return tree.choose(share)


def mean(tree: Tree) -> Column:
    """The mean target of a row's leaf; NULL where nothing was learnt."""
    def value(node: int) -> Column:
        n, total = tree.leaves[node]
        return F.lit(float(total) / float(n) if n else None).cast("double")
    return tree.choose(value)
