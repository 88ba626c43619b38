"""Gradient boosting of the logistic loss with Newton leaves, several models in one pass.

Rows are written once as small bin numbers: a number column has a bin per distinct value, or
parts of equal row counts beyond ``max_bins`` of them; a category column has a bin per level, and its splits
are "this level or any other". Each level of a round is one job: tasks add up, for every (model,
node, column, bin), the rows, the gradients and the hessians, and one task per model merges them.
What reaches the driver is that histogram, whose size is models x nodes x bins and does not grow
with the rows. Split gain is that of the residuals' means; a leaf's value is the Newton step
sum(g) / sum(h).

Gradients are added as integers (multiples of 2^-26, exact up to 10^11 rows), so the sums, the
splits and the scores do not depend on how the rows are partitioned. A bit mask per row names the
models that learn from it; all models (folds, hold-out) grow side by side in the same scans.
Scores so far are written with the rows every ``KEEP`` rounds, which also cuts the lineage.

The rows are dealt out evenly over all cores and packed into blocks of bytes, a column after the
other: a pass hands blocks and not rows to Python, and walks a tree by comparing whole columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators import metrics as M
from parcelwise.operators.encoding import SCHEMA as ENCODING
from parcelwise.operators.encoding import Encoding
from parcelwise.sources.scratch import Scratch

# The reference learner's defaults.
ROUNDS, DEPTH, RATE = 100, 3, 0.1
MAX_BINS = 256
KEEP = 10
#: Rows of a block (8,192 hessians of at most 2^24 are below ``_ROW``), and blocks of a file at most.
BLOCK, FILE_BLOCKS = 8192, 25
STATE = ("label", "members", "margins", "bins")
_UNIT = float(1 << 26)
_ROW = float(1 << 38)
_NO_SPLIT = 1 << 20  # above every bin: all rows go left


@dataclass
class Booster:
    """Fitted trees of one model: per tree the arrays (column, bound, value).

    A tree of depth d has its inner nodes in heap order (children of i: 2i + 1, 2i + 2) and 2^d
    values. Column j is number j, or category j - len(num); a number above its bound and a code
    equal to its bound go right. A node that was not split sends all rows left.
    """

    encoding: Encoding
    start: float
    rate: float
    column: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def margins(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rows = np.concatenate([numbers, codes], axis=1)
        out = np.full(len(rows), self.start)
        for column, bound, value in zip(self.column, self.bound, self.value):
            out += self.rate * value[walk(rows, column, bound, numbers.shape[1])]
        return out

    def predict(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep``, Risk and prediction (risk at least one half)."""
        enc, n_num = self.encoding, len(self.encoding.num)
        given = rows.select(*keep, *enc.numbers(), *enc.codes())
        kept = given.schema[:len(keep)]

        def run(batches):
            for batch in batches:
                x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keep), batch.num_columns)]
                numbers = np.stack(x[:n_num], axis=1) if n_num else np.zeros((batch.num_rows, 0))
                codes = np.stack(x[n_num:], axis=1) if x[n_num:] else np.zeros((batch.num_rows, 0))
                risk = _logistic(self.margins(numbers, codes))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], pa.array(risk), pa.array((risk >= 0.5).astype(float))],
                    names=[*keep, "Risk", "prediction"])
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["Risk double", "prediction double"])
        return given.mapInArrow(run, schema)

    def importances(self) -> list[tuple[str, float]]:
        """Every feature's share of the gain of all splits, over one name per number and level."""
        names = self.encoding.feature_names()
        total = dict.fromkeys(names, 0.0)
        for column, bound, gain in zip(self.column, self.bound, self.gain):
            for c, b, g in zip(column, bound, gain):
                if g > 0:
                    n_num = len(self.encoding.num)
                    name = names[c] if c < n_num else f"{self.encoding.cat[c - n_num]}={self.encoding.levels[c - n_num][int(b)]}"
                    total[name] += float(g)
        every = sum(total.values())
        return [(n, g / every if every else 0.0) for n, g in total.items()]

    def save(self, spark: SparkSession, path: str) -> None:
        """One table: a row per tree and the encoding (bounded by the model, not by the data)."""
        rows = [(t, self.start, self.rate, [int(x) for x in c], [float(x) for x in b], [float(x) for x in v],
                 [float(x) for x in g], *self.encoding.row())
                for t, (c, b, v, g) in enumerate(zip(self.column, self.bound, self.value, self.gain))]
        schema = ("tree int, start double, rate double, column array<int>, bound array<double>, value array<double>, "
                  f"gain array<double>, {ENCODING}")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        rows = spark.read.parquet(path).orderBy("tree").collect()
        r = rows[0]
        return Booster(Encoding.of(r), r["start"], r["rate"], *[np.array([x[c] for x in rows]) for c in ("column", "bound", "value", "gain")])


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-margin))


def walk(rows: np.ndarray, column: np.ndarray, bound: np.ndarray, n_num: int, depth: int | None = None) -> np.ndarray:
    """The place of each row among the nodes of a level (all levels unless ``depth`` is given)."""
    levels = int(math.log2(len(column) + 1)) if depth is None else depth
    place = np.zeros(len(rows), dtype=np.int64)
    every = np.arange(len(rows))
    for level in range(levels):
        node = place + (1 << level) - 1
        c, b = column[node], bound[node]
        x = rows[every, c]
        place = 2 * place + np.where(c < n_num, x > b, x == b)
    return place


def bin_bounds(rows: DataFrame, enc: Encoding, max_bins: int = MAX_BINS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per number column the ascending upper bounds of its bins but the last (halfway between
    neighbouring values, or values that end parts of equal row counts), and a value of each bin."""
    filled = rows.select(*enc.numbers())
    distinct = filled.agg(*[F.count_distinct(f"x{i}").alias(f"x{i}") for i in range(len(enc.num))]).first()
    bounds, centres = [], []
    for i in range(len(enc.num)):
        if distinct[i] <= max_bins:
            known = sorted(r[0] for r in filled.select(f"x{i}").distinct().collect())  # at most max_bins rows
            bounds.append(np.array([(a + b) / 2 for a, b in zip(known, known[1:])]))
            centres.append(np.array(known))
        else:
            counts = filled.groupBy(F.col(f"x{i}").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            sums = M.prefix_sums(counts, "v", ["n"])
            total = sums.agg(F.sum("n")).first()[0]
            part = F.floor(F.col("n_before") * max_bins / F.lit(total))
            tops = [r[0] for r in sums.groupBy(part.alias("part")).agg(F.max("v")).drop("part").collect()]
            bounds.append(np.array(sorted(tops)[:-1]))  # at most max_bins rows
            centres.append(np.array(sorted(tops)))
    return bounds, centres


class _Layout:
    """Where the bins of each column stand in a histogram."""

    def __init__(self, enc: Encoding, bounds: list[np.ndarray], centres: list[np.ndarray]):
        self.n_num = len(enc.num)
        self.bounds = bounds
        # a category column has a further last bin for rows of no level
        self.centres = centres
        self.size = np.array([len(b) + 1 for b in bounds] + [len(x) + 1 for x in enc.levels])
        self.offset = np.cumsum(self.size) - self.size
        self.total = int(self.size.sum())

    def middle(self, j: int, n: np.ndarray, at: int) -> int:
        """The bin that ends the left side when column ``j`` is split after bin ``at``: halfway
        to the next bin in which the node has rows ``n``. Rows that the node has not learnt from
        may stand in between."""
        if j >= self.n_num:
            return at
        low, high = int(np.flatnonzero(n[:at + 1])[-1]), at + 1 + int(np.flatnonzero(n[at + 1:])[0])
        if high == low + 1:
            return low
        centre = self.centres[j]
        return int(np.searchsorted(centre, (centre[low] + centre[high]) / 2, side="right")) - 1

    def bins(self, numbers: list[np.ndarray], codes: list[np.ndarray]) -> list[np.ndarray]:
        found = [np.searchsorted(b, x, side="left") for b, x in zip(self.bounds, numbers)]
        found += [np.where(c < 0, n - 1, c) for c, n in zip(codes, self.size[self.n_num:])]
        return [x.astype(np.int16) for x in found]


def _binned(rows: DataFrame, enc: Encoding, layout: _Layout, keep: list[str], members: Column, label: str,
            starts: list[float]) -> DataFrame:
    """Blocks of at most ``BLOCK`` rows: keep and y as arrays, and as plain bytes, row by row, what every pass
    reads: label, members, margins (one per model) and bins (one per column)."""
    given = rows.select(*keep, F.col(label).cast("int").alias("y"), members.alias("members"), *enc.numbers(), *enc.codes())
    kept, n_num = given.schema[:len(keep)], len(enc.num)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[len(keep) + 2:]]
                y, member = batch.column(len(keep)), batch.column(len(keep) + 1).to_numpy(zero_copy_only=False)
                # a row without a label is learnt from by no model
                member = np.where(y.is_valid().to_numpy(zero_copy_only=False), member, 0).astype(np.int32)
                parts = [y.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32), member,
                         np.repeat(np.array(starts), batch.num_rows), np.stack(layout.bins(x[:n_num], x[n_num:]))]
                ends = pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.ListArray.from_arrays(ends, c) for c in batch.columns[:len(keep) + 1]],
                     *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=[*keep, "y", *STATE])
    schema = ", ".join([f"{f.name} array<{f.dataType.simpleString()}>" for f in kept] + ["y array<int>"]
                       + [f"{c} binary" for c in STATE])
    return given.mapInArrow(run, schema)


def place_of(bins: np.ndarray, column: np.ndarray, bound: np.ndarray, n_num: int, levels: int) -> np.ndarray:
    """``walk`` for bins with a row per column: one comparison of a whole column per inner node."""
    place = np.zeros(bins.shape[1], dtype=np.uint8 if levels <= 8 else np.uint16)
    for level in range(levels):
        right = np.zeros(len(place), dtype=bool)
        for p in range(1 << level):
            node = p + (1 << level) - 1
            if bound[node] >= _NO_SPLIT:
                continue
            c, b = column[node], int(bound[node])
            went = bins[c] > b if c < n_num else bins[c] == b
            right |= (went & (place == p)) if level else went
        place += place
        place += right
    return place


def _blocks(batch: pa.RecordBatch, trees: list[list[tuple]], n_num: int, rate: float):
    """Per block (labels, members, margins of every model after ``trees``, bins), a row per model and column."""
    kinds = (np.int32, np.int32, np.float64, np.int16)
    columns = [batch.column(batch.schema.get_field_index(c)) for c in STATE]
    for i in range(batch.num_rows):
        y, members, margins, bins = [np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(columns, kinds)]
        margins, bins = margins.reshape(len(trees), len(y)).copy(), bins.reshape(-1, len(y))
        for m, grown in enumerate(trees):
            for column, bound, value, _ in grown:
                place = place_of(bins, column, bound, n_num, int(math.log2(len(column) + 1)))
                margins[m] += (rate * value)[place]
        yield y, members, margins, bins


def _histogram(state: DataFrame, trees: list[list[tuple]], growing: list[tuple], level: int, layout: _Layout,
               rate: float) -> np.ndarray:
    """Sums (rows, gradients, hessians) per model, node of the level, and bin."""
    n_models, nodes, n_num = len(trees), 1 << level, layout.n_num
    shape = (n_models, nodes, layout.total)

    def run(batches):
        sums = np.zeros((3, *shape))
        for batch in batches:
            for y, members, margins, bins in _blocks(batch, trees, n_num, rate):
                wide = bins.astype(np.int64)
                for m, (column, bound) in enumerate(growing):
                    mine = ((members >> m) & 1).astype(float)
                    risk = _logistic(margins[m])
                    place = place_of(bins, column, bound, n_num, level).astype(np.int64)
                    # whole numbers below 2^53 a task: their float sums are exact; rows and hessians
                    # (below 2^38 a block) are added as one number
                    grad = np.rint((y - risk) * _UNIT) * mine
                    both = (np.rint(risk * (1 - risk) * _UNIT) + _ROW) * mine
                    for j, (first, size) in enumerate(zip(layout.offset, layout.size)):
                        cell = place * size + wide[j]
                        part = np.bincount(cell, both, nodes * size)
                        n = np.floor(part / _ROW)
                        at = slice(first, first + size)
                        sums[0, m, :, at] += n.reshape(nodes, size)
                        sums[1, m, :, at] += np.bincount(cell, grad, nodes * size).reshape(nodes, size)
                        sums[2, m, :, at] += (part - n * _ROW).reshape(nodes, size)
        yield from by_model(sums.astype(np.int64).transpose(1, 0, 2, 3))

    def by_model(sums):
        yield pa.RecordBatch.from_arrays([pa.array(range(n_models), pa.int32()), pa.array([x.tobytes() for x in sums], pa.binary())],
                                         names=["model", "sums"])

    def merge(batches):
        added = np.zeros((n_models, 3, nodes, layout.total), dtype=np.int64)
        for batch in batches:
            for m, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                added[m] += np.frombuffer(x.as_buffer(), np.int64).reshape(added.shape[1:])
        yield from by_model(added)
    # one row per model and task is shuffled, and added up in one task per model at most
    schema = "model int, sums binary"
    parts = state.select(*STATE).mapInArrow(run, schema).repartition(n_models, "model").mapInArrow(merge, schema)
    out = np.zeros((n_models, 3, nodes, layout.total), dtype=np.int64)
    for r in parts.collect():
        out[r["model"]] += np.frombuffer(r["sums"], np.int64).reshape(out.shape[1:])
    return out.transpose(1, 0, 2, 3) / np.array([1.0, _UNIT, _UNIT])[:, None, None, None]


def best_split(n: np.ndarray, g: np.ndarray, layout: _Layout) -> tuple[int, float, float] | None:
    """(column, bin, gain) of a node from its rows and gradients per bin; equal gains (but for
    the last bits) go to the first."""
    best = None
    for j, (start, size) in enumerate(zip(layout.offset, layout.size)):
        here, grad = n[start:start + size], g[start:start + size]
        rows, whole = here.sum(), grad.sum()
        if j < layout.n_num:
            left, left_g = np.cumsum(here)[:-1], np.cumsum(grad)[:-1]
        else:
            left, left_g = rows - here[:-1], whole - grad[:-1]
        right, right_g = rows - left, whole - left_g
        ok = (left > 0) & (right > 0)
        if not ok.any():
            continue
        diff = np.where(ok, right * left_g - left * right_g, 0.0)
        gain = np.where(ok, diff * diff / np.maximum(left * right * rows, 1.0), -1.0)
        at = int(np.argmax(gain > gain.max() - 1e-9))
        if gain[at] > 1e-12 and (best is None or gain[at] > best[2] + 1e-9):
            best = (j, float(at), float(gain[at]))
    return best


def _newton(g: float, h: float) -> float:
    return g / h if h > 1e-150 else 0.0


def _grow(state: DataFrame, trees: list[list[tuple]], layout: _Layout, depth: int, rate: float) -> list[tuple]:
    """The next tree of every model: (column, bound, value, gain)."""
    n_models, inner = len(trees), (1 << depth) - 1
    made = [(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << depth), np.zeros(inner))
            for _ in range(n_models)]
    for column, bound, _, _ in made:
        bound[:] = _NO_SPLIT
    for level in range(depth):
        sums = _histogram(state, trees, [(c, b) for c, b, _, _ in made], level, layout, rate)
        for m, (column, bound, value, gain) in enumerate(made):
            for place in range(1 << level):
                n, g, h = sums[:, m, place]
                split = best_split(n, g, layout)
                node = (1 << level) - 1 + place
                first = slice(layout.offset[0], layout.offset[0] + layout.size[0])  # any column's bins hold all rows
                whole = (g[first].sum(), h[first].sum())
                leaf = place << (depth - level)
                if split is None:
                    value[leaf] = _newton(*whole)
                    continue
                j, at, won = split
                at = layout.middle(j, n[layout.offset[j]:layout.offset[j] + layout.size[j]], int(at))
                column[node], bound[node], gain[node] = j, at, won
                bins = slice(layout.offset[j], layout.offset[j] + layout.size[j])
                goes = np.arange(layout.size[j]) > at if j < layout.n_num else np.arange(layout.size[j]) == at
                right = (g[bins][goes].sum(), h[bins][goes].sum())
                value[leaf] = _newton(whole[0] - right[0], whole[1] - right[1])
                value[leaf + (1 << (depth - level - 1))] = _newton(*right)
    return made


def fit_boosters(rows: DataFrame, members: Sequence[Column], num: Sequence[str], cat: Sequence[str], label: str = "RTO",
                 keep: Sequence[str] = ("OrderID",), rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
                 max_bins: int = MAX_BINS) -> tuple[list[Booster], DataFrame]:
    """One model per condition in ``members`` (rows where it holds are learnt from), and the table
    of ``keep``, y and every model's risk of every row as ``risks``."""
    if not 0 < len(members) <= 31:
        raise ValueError("between 1 and 31 models")
    scratch = Scratch(rows.sparkSession, "boosting")
    mask = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << m)).otherwise(F.lit(0)) for m, c in enumerate(members)),
               F.lit(0)).cast("int")
    known = rows.where(F.col(label).isNotNull())
    learnt = known.where(mask > 0)
    enc = Encoding.fit(learnt, num, cat)
    layout = _Layout(enc, *bin_bounds(learnt, enc, max_bins))
    counts = learnt.agg(*[F.count_if(c).alias(f"n{m}") for m, c in enumerate(members)],
                        *[F.count_if(c & (F.col(label) == 1)).alias(f"p{m}") for m, c in enumerate(members)]).first()
    starts = []
    for m in range(len(members)):
        share = counts[f"p{m}"] / counts[f"n{m}"] if counts[f"n{m}"] else 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        starts.append(math.log(share / (1 - share)))
    # the rows are dealt out before they are packed: a table may come in few files
    cores = rows.sparkSession.sparkContext.defaultParallelism
    state = scratch.blocks(_binned(rows.repartition(cores), enc, layout, list(keep), mask, label, starts), "state", FILE_BLOCKS)
    fresh: list[list[tuple]] = [[] for _ in members]
    grown: list[list[tuple]] = [[] for _ in members]
    for r in range(rounds):
        for m, tree in enumerate(_grow(state, fresh, layout, depth, rate)):
            fresh[m].append(tree)
            grown[m].append(tree)
        if (r + 1) % KEEP == 0 and r + 1 < rounds:
            after = scratch.blocks(_advanced(state, fresh, layout, rate), "state", FILE_BLOCKS)
            scratch.drop(state)
            state, fresh = after, [[] for _ in members]
    models = [_named(enc, layout, start, rate, trees) for start, trees in zip(starts, grown)]
    risks = F.transform("margins", lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
    out = scratch.table(_unpacked(state, fresh, layout, rate).select(*keep, "y", risks.alias("risks")), "risks")
    scratch.drop(state)
    return models, out


def _advanced(state: DataFrame, trees: list[list[tuple]], layout: _Layout, rate: float) -> DataFrame:
    """The state after ``trees``."""
    place = state.columns.index("margins")

    def run(batches):
        for batch in batches:
            after = [margins.tobytes() for _, _, margins, _ in _blocks(batch, trees, layout.n_num, rate)]
            yield batch.set_column(place, "margins", pa.array(after, pa.binary()))
    return state.mapInArrow(run, state.schema)


def _unpacked(state: DataFrame, trees: list[list[tuple]], layout: _Layout, rate: float) -> DataFrame:
    """One row per row again, after ``trees``: the kept columns, y and margins (one per model)."""
    names = state.columns[:state.columns.index("y") + 1]

    def run(batches):
        for batch in batches:
            for i, (y, _, margins, _) in enumerate(_blocks(batch, trees, layout.n_num, rate)):
                kept = [batch.column(c).slice(i, 1).flatten() for c in range(len(names))]
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(trees))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(margins.T).ravel()))
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*names, "margins"])
    schema = [f"{f.name} {f.dataType.elementType.simpleString()}" for f in state.schema[:len(names)]]
    return state.mapInArrow(run, ", ".join([*schema, "margins array<double>"]))


def _named(enc: Encoding, layout: _Layout, start: float, rate: float, trees: list[tuple]) -> Booster:
    """Trees over bins as trees over values: a bin's bound in place of its number."""
    bounds = []
    for column, bound, _, gain in trees:
        out = np.full(len(bound), np.inf)
        for i, (c, b, g) in enumerate(zip(column, bound, gain)):
            if g > 0:
                out[i] = layout.bounds[c][int(b)] if c < layout.n_num else b
        bounds.append(out)
    stacked = [np.array([t[k] for t in trees]) for k in (0, 2, 3)]
    return Booster(enc, start, rate, stacked[0], np.array(bounds), stacked[1], stacked[2])
