"""Random forest of Gini trees whose trees all grow in the same scans.

Rows are written once as small bin numbers (``boosting.bin_bounds``). How often a tree learns from
a row is a Poisson(1) draw from a hash of the row's key and the tree's number, so a bootstrap needs
no pass of its own, is the same on every rerun and does not depend on partitions. Every node draws
sqrt(features) of the features (numbers, and one "is this level" per level) by a hash of tree, node
and feature.

A pass is one job over the rows and serves the large open nodes of all trees: tasks count both classes
per (node, drawn feature, bin), Spark adds the counts up by a shuffle on (node, feature), the counts
of a feature are read in the order of its bins with running sums, and one row per node, the best
split, reaches the driver (the size of the model, whatever the number of rows). Deep levels have
about as many cells as rows, so counting them that way would shuffle rows x trees x features cells
a level. A node that learns from at most ``GROUP_ROWS`` rows is therefore left for the last job: its
rows, a byte per bin, are shuffled once to a group of its own, which grows the node to its end by the
same rules. A node whose drawn features are all constant stays open and draws the next ones, until it
has tried every feature. Counts are whole numbers, so splits do not depend on how the rows are
partitioned or on where a node is grown.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators.boosting import _NO_SPLIT, MAX_BINS, _Layout, bin_bounds, place_of, walk
from parcelwise.operators.encoding import SCHEMA as ENCODING
from parcelwise.operators.encoding import Encoding
from parcelwise.sources.scratch import Scratch

# The reference learner's settings.
TREES, DEPTH, SEED = 300, 12, 42
#: Counted places (row, feature) a task holds at once, and rows of a file: every row is
#: worked on once per tree, so files are far smaller than those of other tables.
SLICE = 2_000_000
TASK_ROWS = 50_000
#: A node that learns from at most so many rows (repeats counted) is grown to its end in one group.
GROUP_ROWS = 200_000
#: Cells (open node, drawn feature, bin) counted in one pass at most; more nodes take several passes.
PASS_CELLS = 4_000_000
#: Bytes of gathered rows for a task that grows groups, about.
GROUP_BYTES = 32 << 20


@dataclass
class Forest:
    """Fitted trees, one row per tree: inner nodes in heap order as in ``boosting.Booster``, and
    the weighted share of label 1 in each leaf."""

    encoding: Encoding
    column: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def risks(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        rows = np.concatenate([numbers, codes], axis=1)
        out = np.zeros(len(rows))
        for column, bound, value in zip(self.column, self.bound, self.value):
            out += value[walk(rows, column, bound, numbers.shape[1])]
        return out / len(self.column)

    def predict(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep``, Risk (mean of the trees) and prediction (risk above one half)."""
        enc, n_num = self.encoding, len(self.encoding.num)
        given = rows.select(*keep, *enc.numbers(), *enc.codes())
        kept = given.schema[:len(keep)]

        def run(batches):
            for batch in batches:
                x = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(keep):]]
                x = np.stack(x, axis=1) if x else np.zeros((batch.num_rows, 0))
                risk = self.risks(x[:, :n_num], x[:, n_num:])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(keep)], pa.array(risk), pa.array((risk > 0.5).astype(float))],
                    names=[*keep, "Risk", "prediction"])
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["Risk double", "prediction double"])
        return given.mapInArrow(run, schema)

    def importances(self) -> list[tuple[str, float]]:
        """Mean over the trees of every feature's share of a tree's impurity decrease."""
        names, n_num = self.encoding.feature_names(), len(self.encoding.num)
        first = np.cumsum([n_num, *[len(x) for x in self.encoding.levels]])
        total, grown = np.zeros(len(names)), 0
        for column, bound, gain in zip(self.column, self.bound, self.gain):
            split = np.flatnonzero(np.isfinite(bound))
            every = gain[split].sum()
            if every > 0:
                grown += 1
                feature = [c if c < n_num else first[c - n_num] + int(b) for c, b in zip(column[split], bound[split])]
                np.add.at(total, np.array(feature, dtype=int), gain[split] / every)
        return [(n, float(t) / grown if grown else 0.0) for n, t in zip(names, total)]

    def save(self, spark: SparkSession, path: str) -> None:
        """One table: a row per tree and the encoding (bounded by the model, not by the data)."""
        trees = pa.table({"tree": pa.array(range(len(self.column)), pa.int32()),
                          "column": pa.array(self.column.astype(np.int32).tolist(), pa.list_(pa.int32())),
                          **{k: pa.array(getattr(self, k).tolist(), pa.list_(pa.float64())) for k in ("bound", "value", "gain")}})
        enc = spark.createDataFrame([self.encoding.row()], ENCODING)
        spark.createDataFrame(trees).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        enc.coalesce(1).write.mode("overwrite").parquet(f"{path}/encoding")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        rows = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        enc = Encoding.of(spark.read.parquet(f"{path}/encoding").first())
        return Forest(enc, *[np.array([r[c] for r in rows]) for c in ("column", "bound", "value", "gain")])


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(*parts) -> np.ndarray:
    """One hash of several whole numbers or arrays of them (broadcast against each other)."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = _mix((np.asarray(part).astype(np.uint64) ^ out) + np.uint64(0x9E3779B97F4A7C15))
    return out


# P(Poisson(1) <= k) for k = 0, 1, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def draws(keys: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each tree (columns) learns from each row (rows)."""
    part = _hashed(seed, keys[:, None], trees[None, :]) >> np.uint64(11)
    return np.searchsorted(_POISSON, part / float(1 << 53), side="right")


def _times(keys: np.ndarray, trees: Sequence[int], seed: int):
    """The columns of ``draws``, one after the other; the keys are hashed once for all of them."""
    known = _hashed(seed, keys)
    for tree in trees:
        with np.errstate(over="ignore"):
            part = _mix((np.uint64(tree) ^ known) + np.uint64(0x9E3779B97F4A7C15))
        part = (part >> np.uint64(11)) / float(1 << 53)
        times = np.zeros(len(part), dtype=np.uint8)
        for bound in _POISSON:
            more = part >= bound
            if not more.any():
                break
            times += more
        yield tree, times


def drawn_features(tree: np.ndarray, node: np.ndarray, attempt: np.ndarray, n_features: int, m: int, seed: int) -> np.ndarray:
    """The ``m`` features that each node tries at its attempt: the next ones in its hash order."""
    out = np.zeros((len(tree), m), dtype=np.int16)
    for i in range(0, len(tree), 50_000):
        part = slice(i, i + 50_000)
        order = np.argsort(_hashed(seed + 1, tree[part, None], node[part, None], np.arange(n_features)[None, :]), axis=1)
        place = np.minimum(attempt[part, None] * m + np.arange(m), n_features - 1)
        out[part] = np.take_along_axis(order, place, axis=1)
    return out


def gini_gain(left: Sequence[np.ndarray], total: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    """Decrease of the weighted impurity from the rows of both classes on the left and in all."""
    def purity(n0, n1):
        a, b = n0 * weights[0], n1 * weights[1]
        return (a * a + b * b) / (a + b)
    return purity(*left) + purity(total[0] - left[0], total[1] - left[1]) - purity(*total)


def _binned(rows: DataFrame, enc: Encoding, layout: _Layout, keys: Sequence[str], label: str) -> DataFrame:
    """row_key, y and the bins b0, b1, ..."""
    given = rows.select(F.xxhash64(*keys).alias("row_key"), F.col(label).cast("int").alias("y"), *enc.numbers(), *enc.codes())
    n_num, n_col = len(enc.num), len(layout.size)

    def run(batches):
        for batch in batches:
            x = [c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]
            made = layout.bins(x[:n_num], x[n_num:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(b) for b in made]],
                                             names=["row_key", "y", *[f"b{j}" for j in range(n_col)]])
    return given.mapInArrow(run, ", ".join(["row_key long, y int"] + [f"b{j} smallint" for j in range(n_col)]))


class _Cells:
    """Cells of (open node, drawn feature, value): numbers of the cells that can have rows, without gaps."""

    def __init__(self, features: np.ndarray, kinds: np.ndarray, size: np.ndarray):
        self.column, self.level = kinds[features][..., 0], kinds[features][..., 1]
        width = np.where(self.level < 0, size[self.column], 2).ravel()
        self.first = (np.cumsum(width) - width).reshape(features.shape)
        self.part = np.repeat(np.arange(len(width)), width)  # node * features + slot
        self.place = np.arange(len(self.part)) - self.first.ravel()[self.part]
        self.total = len(self.part)

    def span(self, low: int, high: int) -> slice:
        """The cells of the nodes ``low`` to ``high - 1``."""
        ends = np.append(self.first[:, 0], self.total)
        return slice(int(ends[low]), int(ends[high]))

    def count(self, bins: np.ndarray, node: np.ndarray, y: np.ndarray, times: np.ndarray, span: slice) -> np.ndarray:
        """Rows of label 0 and 1 per cell of ``span`` (``bins`` has a row per row; repeats count)."""
        total = span.stop - span.start
        out, step = np.zeros((2, total)), max(1, SLICE // self.first.shape[1])
        for at in range(0, len(node), step):
            part = slice(at, at + step)
            mine = node[part]
            value = np.take_along_axis(bins[part], self.column[mine], axis=1).astype(np.int64)
            level = self.level[mine]
            cell = (np.where(level < 0, value, value == level) + (self.first[mine] - span.start)).ravel()
            every = times[part].astype(float)
            out[0] += np.bincount(cell, np.repeat(every, self.first.shape[1]), total)
            out[1] += np.bincount(cell, np.repeat(every * y[part], self.first.shape[1]), total)
        out[0] -= out[1]
        return out.astype(np.int64)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, labels, bins with a row per column)."""
    return (batch.column(0).to_numpy(), batch.column(1).to_numpy(),
            np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]))


def _counts(state: DataFrame, column: np.ndarray, bound: np.ndarray, at: np.ndarray, level: int, cells: _Cells,
            n_num: int, width: int, seed: int) -> DataFrame:
    """Rows of label 0 and 1 per cell: (open node, drawn feature, bin) as one number."""
    growing = np.flatnonzero((at >= 0).any(axis=1))
    # a tree's open nodes are neighbours, and so are their cells
    spans = {t: cells.span(int(at[t][at[t] >= 0].min()), int(at[t].max()) + 1) for t in growing}

    def run(batches):
        counts = np.zeros((2, cells.total), dtype=np.int64)
        for batch in batches:
            keys, y, bins = _read(batch)
            rows = np.ascontiguousarray(bins.T)
            for t, times in _times(keys, growing, seed):
                node = at[t, place_of(bins, column[t], bound[t], n_num, level)]
                mine = np.flatnonzero((node >= 0) & (times > 0))
                counts[:, spans[t]] += cells.count(rows[mine], node[mine], y[mine], times[mine], spans[t])
        some = np.flatnonzero(counts.any(axis=0))
        number = cells.part[some] * width + cells.place[some]
        yield pa.RecordBatch.from_arrays([pa.array(number), *[pa.array(c[some]) for c in counts]], names=["cell", "n0", "n1"])
    found = state.mapInArrow(run, "cell long, n0 long, n1 long").withColumn("part", F.expr(f"cell div {width}"))
    return found.repartition("part").groupBy("part", "cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _best_of(part: np.ndarray, place: np.ndarray, n0: np.ndarray, n1: np.ndarray, m: int, weights: tuple[float, float]) -> list:
    """The columns ``_FOUND`` per part (node * m + slot): its best split, equal gains to the lower bin.
    Cells with rows, in the order of their parts and bins."""
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    group = np.cumsum(np.diff(part, prepend=-1) != 0) - 1
    ends = np.append(starts[1:], len(part)) - 1
    total = [np.add.reduceat(n, starts) for n in (n0, n1)]
    left = [np.cumsum(n) - (np.cumsum(n) - n)[starts][group] for n in (n0, n1)]
    inside = np.ones(len(part), dtype=bool)
    inside[ends] = False
    gain = np.full(len(part), -np.inf)
    gain[inside] = gini_gain([x[inside] for x in left], [t[group][inside] for t in total], weights)
    top = np.maximum.reduceat(gain, starts)
    at = np.minimum.reduceat(np.where(gain == top[group], np.arange(len(part)), len(part)), starts)
    ok = np.isfinite(top)
    return [part[starts] // m, part[starts] % m, ok, np.where(ok, top, 0.0), place[at],
            place[np.where(ok, at + 1, at)], left[0][at], left[1][at], *total]


_FOUND = ("node", "slot", "ok", "gain", "low", "high", "l0", "l1", "t0", "t1")


def _best_splits(counts: DataFrame, m: int, width: int, weights: tuple[float, float]) -> DataFrame:
    """Per open node the best split of its drawn features; equal gains go to the feature drawn
    first and the lower bin."""
    def best(cell, n0, n1):
        found = _best_of(cell // width, cell % width, n0, n1, m, weights)
        return pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=list(_FOUND))

    def run(batches):
        held = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            if batch.num_rows:
                held = [np.append(h, c.to_numpy()) for h, c in zip(held, batch.columns)]
                # the last feature's counts (at most ``width`` rows) may go on in the next batch
                whole = int(np.searchsorted(held[0], held[0][-1] // width * width))
                if whole:
                    yield best(*[h[:whole] for h in held])
                held = [h[whole:] for h in held]
        if len(held[0]):
            yield best(*held)
    schema = "node long, slot long, ok boolean, gain double, low long, high long, l0 long, l1 long, t0 long, t1 long"
    found = counts.sortWithinPartitions("cell").select("cell", "n0", "n1").mapInArrow(run, schema)
    rank = F.struct("ok", "gain", -F.col("slot"))
    return found.groupBy("node").agg(F.max_by(F.struct(*_FOUND[1:]), rank).alias("best")).select("node", "best.*")


@dataclass
class _Rules:
    """What every node is grown by, besides its rows."""

    layout: _Layout
    kinds: np.ndarray  # per feature its column and its level (-1: a number)
    weights: tuple[float, float]
    depth: int
    seed: int

    @property
    def drawn(self) -> int:
        return max(1, math.isqrt(len(self.kinds)))

    def features(self, nodes: np.ndarray, tree: np.ndarray) -> np.ndarray:
        _, level, place, attempt = nodes.T
        return drawn_features(tree, (1 << level) - 1 + place, attempt, len(self.kinds), self.drawn, self.seed)


class _Trees:
    """Trees as they grow. Open nodes are rows of (tree, level, place in the level, attempt)."""

    def __init__(self, trees: int, depth: int):
        self.column = np.zeros((trees, (1 << depth) - 1), dtype=np.int16)
        self.bound = np.full(self.column.shape, _NO_SPLIT, dtype=np.int32)
        self.gain, self.value = np.zeros(self.column.shape), np.full((trees, 1 << depth), 0.5)

    def split(self, nodes: np.ndarray, features: np.ndarray, found: dict, rules: _Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split the nodes as ``found``. The nodes open now, their rows, and the number of the open node
        on the left and right of each node that was open before (-1: none)."""
        layout, kinds, weights, depth, n_num = rules.layout, rules.kinds, rules.weights, rules.depth, rules.layout.n_num
        mine, features = nodes[found["node"]], features[found["node"], found["slot"]]
        tree, level, place, attempt = mine.T
        total, left = [found["t0"], found["t1"]], [found["l0"], found["l1"]]
        self.value[tree, place << (depth - level)] = _share(total, weights)
        mixed = (total[0] > 0) & (total[1] > 0)
        again = mixed & ~found["ok"] & ((attempt + 1) * rules.drawn < len(kinds))
        split = mixed & found["ok"]
        j, at_level = kinds[features].T
        heap = (1 << level) - 1 + place
        self.column[tree[split], heap[split]] = j[split]
        self.gain[tree[split], heap[split]] = found["gain"][split]
        bound = np.where(at_level < 0, _between(layout, j, found["low"], found["high"]), at_level)
        self.bound[tree[split], heap[split]] = bound[split]
        opened, rows = [mine[again] + [0, 0, 0, 1]], [sum(total)[again]]
        after = np.full((len(nodes), 2), -1, dtype=np.int64)
        after[found["node"][again]] = np.arange(again.sum())[:, None]
        for side, count in enumerate((left, [t - x for t, x in zip(total, left)])):
            child = ((2 * place + side) << np.maximum(depth - level - 1, 0))[split]
            self.value[tree[split], child] = _share([c[split] for c in count], weights)
            more = split & (level + 1 < depth) & (count[0] > 0) & (count[1] > 0)
            after[found["node"][more], side] = sum(map(len, opened)) + np.arange(more.sum())
            opened.append(np.stack([tree, level + 1, 2 * place + side, np.zeros_like(tree)], axis=1)[more])
            rows.append(sum(count)[more])
        return np.concatenate(opened), np.concatenate(rows), after


def _grow_group(bins: np.ndarray, y: np.ndarray, times: np.ndarray, start: np.ndarray, rules: _Rules) -> _Trees:
    """The tree of the open node ``start`` from there on, learnt from the rows that reach it."""
    grown, n_num = _Trees(1, rules.depth), rules.layout.n_num
    nodes, node = start[None, :] * [0, 1, 1, 1], np.zeros(len(y), dtype=np.int64)
    while len(nodes):
        features = rules.features(nodes, np.full(len(nodes), start[0]))
        cells = _Cells(features, rules.kinds, rules.layout.size)
        counts = cells.count(bins, node, y, times, cells.span(0, len(nodes)))
        some = np.flatnonzero(counts.any(axis=0))
        found = dict(zip(_FOUND, _best_of(cells.part[some], cells.place[some], *counts[:, some], rules.drawn, rules.weights)))
        order = np.lexsort((found["slot"], -found["gain"], ~found["ok"], found["node"]))
        order = order[np.flatnonzero(np.diff(found["node"][order], prepend=-1))]
        after_nodes, _, after = grown.split(nodes, features, {k: v[order] for k, v in found.items()}, rules)
        heap = ((1 << nodes[:, 1]) - 1 + nodes[:, 2])[node]
        column, bound = grown.column[0, heap], grown.bound[0, heap]
        value = bins[np.arange(len(node)), column]
        right = (bound < _NO_SPLIT) & np.where(column < n_num, value > bound, value == bound)
        node = after[node, right.astype(np.int64)]
        stay = np.flatnonzero(node >= 0)
        bins, y, times, node, nodes = bins[stay], y[stay], times[stay], node[stay], after_nodes
    return grown


def _grown(state: DataFrame, trees: _Trees, nodes: np.ndarray, rows: int, rules: _Rules) -> pa.Table:
    """Every node of ``nodes`` grown to its end: the splits below it and the values of its leaves."""
    at, level = _places(nodes, len(trees.column))
    n_col, n_num, depth, seed = len(rules.layout.size), rules.layout.n_num, rules.depth, rules.seed
    kind = np.uint8 if int(rules.layout.size.max(initial=1)) <= 256 else np.int16
    growing = np.flatnonzero((at >= 0).any(axis=1))
    column, bound = trees.column, trees.bound

    def gather(batches):
        for batch in batches:
            keys, y, bins = _read(batch)
            packed = np.concatenate([bins, y[None, :]]).T.astype(kind)
            ids, parts = [], []
            for t, times in _times(keys, growing, seed):
                node = at[t, place_of(bins, column[t], bound[t], n_num, level)]
                mine = np.flatnonzero((node >= 0) & (times > 0))
                mine = mine[np.argsort(node[mine], kind="stable")]
                here, given = node[mine], packed[mine]
                given[:, n_col] += 2 * times[mine].astype(kind)
                first = np.flatnonzero(np.diff(here, prepend=-1))
                ids.append(here[first])
                parts += [x.tobytes() for x in np.split(given, first[1:])] if len(first) else []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids).astype(np.int64)), pa.array(parts, pa.binary())],
                                             names=["node", "rows"])

    def grow(table):
        number = table.column("node")[0].as_py()
        given = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("rows")]).reshape(-1, n_col + 1)
        last = given[:, n_col].astype(np.int64)
        made = _grow_group(given[:, :n_col], last % 2, last // 2, nodes[number], rules)
        _, at_level, place, _ = nodes[number]
        heap = np.flatnonzero(made.bound[0] < _NO_SPLIT)
        leaves = slice(place << (depth - at_level), (place + 1) << (depth - at_level))
        lists = [heap, made.column[0, heap], made.bound[0, heap], made.gain[0, heap], made.value[0, leaves]]
        return pa.table([pa.array([number], pa.int64()), *[pa.array([x.tolist()], pa.list_(t)) for x, t in zip(
            lists, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))]], names=list(_GROWN))
    schema = "node long, heap array<int>, column array<int>, bound array<int>, gain array<double>, value array<double>"
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, rows * (n_col + 1) * np.dtype(kind).itemsize // GROUP_BYTES)
    dealt = state.mapInArrow(gather, "node long, rows binary").repartition(int(tasks), "node")
    return dealt.groupBy("node").applyInArrow(grow, schema).toArrow()  # the size of the model


_GROWN = ("node", "heap", "column", "bound", "gain", "value")


def _places(nodes: np.ndarray, trees: int) -> tuple[np.ndarray, int]:
    """The number of the open node at each place of the deepest open level (-1: none), and that level."""
    tree, level, place, _ = nodes.T
    deepest = int(level.max())
    at = np.full((trees, 1 << deepest), -1, dtype=np.int32)
    at[tree, place << (deepest - level)] = np.arange(len(nodes))
    return at, deepest


def fit_forest(rows: DataFrame, num: Sequence[str], cat: Sequence[str], label: str = "RTO",
               keys: Sequence[str] = ("OrderID",), trees: int = TREES, depth: int = DEPTH, seed: int = SEED,
               max_bins: int = MAX_BINS, member: Column | None = None) -> Forest:
    """A forest with balanced class weights, learnt from the rows with a label (where ``member``
    holds, if given). ``keys`` name a row for its bootstrap draws; rows with equal keys draw alike.
    Missing numbers take the median; no rows give risk one half."""
    known = rows.where(F.col(label).isNotNull() if member is None else F.col(label).isNotNull() & member)
    enc = Encoding.fit(known, num, cat)
    layout = _Layout(enc, *bin_bounds(known, enc, max_bins))
    scratch = Scratch(rows.sparkSession, "forest")
    n = known.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, sum(n) // TASK_ROWS)
    state = scratch.table(_binned(known, enc, layout, keys, label).repartition(tasks), "rows")
    kinds = np.array([(j, -1) for j in range(len(num))] + [(len(num) + j, v) for j, x in enumerate(enc.levels)
                                                           for v in range(len(x))])
    rules = _Rules(layout, kinds, tuple(sum(n) / (2 * c) if c else 1.0 for c in n), depth, seed)
    m, width = rules.drawn, max(2, int(layout.size[:len(num)].max(initial=2)))
    grown = _Trees(trees, depth)
    nodes = np.zeros((trees if sum(n) else 0, 4), dtype=np.int64)
    nodes[:, 0] = np.arange(len(nodes))
    learnt = np.full(len(nodes), sum(n))
    small, small_rows = [], 0
    while len(nodes):
        few = learnt <= GROUP_ROWS
        small.append(nodes[few])
        small_rows += int(learnt[few].sum())
        nodes = nodes[~few]
        nodes = nodes[np.argsort(nodes[:, 0], kind="stable")]
        opened = [(nodes[:0], learnt[:0])]
        every = rules.features(nodes, nodes[:, 0])
        sizes = np.where(kinds[every][..., 1] < 0, layout.size[kinds[every][..., 0]], 2).sum(axis=1)
        for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(np.cumsum(sizes) // PASS_CELLS)) + 1):
            if len(part):
                mine, features = nodes[part], every[part]
                at, level = _places(mine, trees)
                cells = _Cells(features, kinds, layout.size)
                counts = _counts(state, grown.column, grown.bound, at, level, cells, len(num), width, seed)
                found = _best_splits(counts, m, width, rules.weights).toArrow().sort_by("node")
                opened.append(grown.split(mine, features, {k: found.column(k).to_numpy() for k in found.column_names}, rules)[:2])
        nodes, learnt = [np.concatenate(x) for x in zip(*opened)]
    small = np.concatenate([np.zeros((0, 4), dtype=np.int64), *small])
    if len(small):
        for r in _grown(state, grown, small, small_rows, rules).to_batches():
            for node, *lists in zip(*[c.to_numpy(zero_copy_only=False) for c in r.columns]):
                tree, level, place, _ = small[node]
                heap, column, bound, gain, value = lists
                grown.column[tree, heap], grown.bound[tree, heap], grown.gain[tree, heap] = column, bound, gain
                grown.value[tree, place << (depth - level):(place + 1) << (depth - level)] = value
    scratch.drop(state)
    values = np.full(grown.bound.shape, np.inf)
    for j in range(len(layout.size)):
        here = (grown.column == j) & (grown.bound < _NO_SPLIT)
        values[here] = layout.bounds[j][grown.bound[here]] if j < len(num) else grown.bound[here]
    return Forest(enc, grown.column.astype(np.int64), values, grown.value, grown.gain)


def _share(count: Sequence[np.ndarray], weights: Sequence[float]) -> np.ndarray:
    """Weighted share of label 1."""
    return count[1] * weights[1] / (count[0] * weights[0] + count[1] * weights[1])


def _between(layout: _Layout, column: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The last bin on the left of splits halfway between two bins that have rows (numbers only)."""
    out = low.copy()
    for j, centre in enumerate(layout.centres):
        here = (column == j) & (high > low + 1)
        out[here] = np.searchsorted(centre, (centre[low[here]] + centre[high[here]]) / 2, side="right") - 1
    return out
