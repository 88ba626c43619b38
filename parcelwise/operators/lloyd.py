"""K-Means for several numbers of groups and several starts in the same scans.

Starts are k-means++ draws: the next centre is the row with the least -ln(u) / d^2, where u is a
hash of the row's key, the start and the step, and d the distance to the nearest centre so far; that
is a draw with weights d^2, made by a minimum that tasks combine. The first k centres of a start
serve the model of k groups, so one pass a step serves all models. Each Lloyd pass then counts and
adds up the rows of every group of every model that still moves. Coordinates are added as whole
multiples of 2^-24, so centres do not depend on how the rows are partitioned. The rows are dealt out
evenly over all cores first: a table of shoppers is small enough to come in one file.

What reaches the driver are the centres: models x groups x columns numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.forest import _hashed
from parcelwise.sources.scratch import Scratch

# The reference learner's defaults.
TOLERANCE, MAX_ITER = 1e-4, 300
_UNIT = float(1 << 24)
#: Rows of a file at most.
FILE_ROWS = 200_000


@dataclass(frozen=True)
class Centres:
    """Fitted groups: ``points`` has a row per group, ``cost`` is the sum of squared distances."""

    points: np.ndarray
    cost: float

    def group(self, x: Column) -> Column:
        """0-based number of the nearest centre of an array column; ties go to the lower number."""
        def distance(centre):
            return sum(((x[j] - F.lit(float(c))) * (x[j] - F.lit(float(c))) for j, c in enumerate(centre)), F.lit(0.0))
        apart = F.array(*[distance(c) for c in self.points])
        return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` with the further column prediction."""
        return rows.withColumn("prediction", self.group(vector_to_array(features)))


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(keys, coordinates) of a batch of row_key, x."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(), flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, added up column by column in a fixed order."""
    out = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        step = x[:, j, None] - centres[None, :, j]
        out += step * step
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, squared distance) of each row's nearest centre, ties to the lower number; ``x`` has a
    row per column. The distances are those of ``squared``."""
    group, least = np.zeros(x.shape[1], dtype=np.intp), None
    for g, centre in enumerate(centres):
        apart = np.zeros(x.shape[1])
        for column, c in zip(x, centre):
            step = column - c
            step *= step
            apart += step
        if least is None:
            least = apart
        else:
            nearer = apart < least
            np.copyto(group, g, where=nearer)
            np.copyto(least, apart, where=nearer)
    return group, least


def race(keys: np.ndarray, start: int, step: int, weight: np.ndarray) -> np.ndarray:
    """Arrival of each row in the draw of a start's next centre; the least wins, weight 0 never."""
    u = ((_hashed(start, step, keys) >> np.uint64(11)) + 1.0) / float(1 << 53)
    return np.where(weight > 0, -np.log(u) / np.where(weight > 0, weight, 1.0), np.inf)


def _next_centres(table: DataFrame, centres: dict[int, np.ndarray], step: int) -> dict[int, np.ndarray]:
    """Per start the row drawn as its next centre (none if every row lies on a centre)."""
    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            keys, x = _points(batch)
            if not len(keys):
                continue
            for start, known in centres.items():
                weight = squared(x, known).min(axis=1) if len(known) else np.ones(len(x))
                arrival = race(keys, start, step, weight)
                at = np.lexsort((keys, arrival))[0]
                found = (arrival[at], keys[at], x[at])
                if np.isfinite(found[0]) and (start not in best or found[:2] < best[start][:2]):
                    best[start] = found
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()], pa.float64()),
             pa.array([b[1] for b in best.values()], pa.int64()), pa.array([b[2].tolist() for b in best.values()], pa.list_(pa.float64()))],
            names=["start", "arrival", "row_key", "x"])
    found = table.mapInArrow(run, "start int, arrival double, row_key long, x array<double>")
    rows = found.groupBy("start").agg(F.min_by("x", F.struct("arrival", "row_key")).alias("x")).collect()  # one a start
    return {r["start"]: np.array(r["x"]) for r in rows}


def _pass(table: DataFrame, models: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple]:
    """Per model (rows, sums of the columns, squared distances) of each group."""
    names, first = list(models), np.cumsum([0, *[len(c) for c in models.values()]])

    def run(batches):
        sums = None
        for batch in batches:
            _, x = _points(batch)
            if not len(x):
                continue
            columns = np.ascontiguousarray(x.T)
            whole = np.rint(columns * _UNIT)
            if sums is None:
                sums = np.zeros((first[-1], x.shape[1] + 2), dtype=np.int64)
            for at, name in zip(first, names):
                (group, least), n = nearest(columns, models[name]), len(models[name])
                # whole numbers below 2^53 a batch: their float sums are exact
                added = [np.bincount(group, None, n), *[np.bincount(group, c, n) for c in (*whole, np.rint(least * _UNIT))]]
                sums[at:at + n] += np.stack(added, axis=1).astype(np.int64)
        if sums is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sums))), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["place", "sums"])
    found = table.mapInArrow(run, "place long, sums array<long>")
    width = max(c.shape[1] for c in models.values()) + 2
    rows = found.groupBy("place").agg(*[F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(width)]).collect()
    sums = np.zeros((first[-1], width))
    for r in rows:  # one a group of a model
        sums[r["place"]] = [float(v) for v in r[1:]]
    return {m: (sums[a:b, 0], sums[a:b, 1:-1] / _UNIT, sums[a:b, -1] / _UNIT) for m, a, b in zip(names, first, first[1:])}


def fit(rows: DataFrame, ks: Sequence[int], starts: Sequence[int], key: str = "CustomerID", features: str = "features",
        tolerance: float = TOLERANCE, max_iter: int = MAX_ITER) -> dict[tuple[int, int], Centres]:
    """Groups per (k, start). A model stops when its centres move by no more than ``tolerance`` times
    the mean variance of the columns (sum of squares). A group without rows keeps its centre; with
    fewer different rows than k there are fewer groups; no rows give no models."""
    scratch = Scratch(rows.sparkSession, "lloyd")
    points = rows.select(F.xxhash64(key).alias("row_key"), vector_to_array(features).alias("x"))
    table = scratch.dealt(points, "points", FILE_ROWS)
    drawn: dict[int, list] = {s: [] for s in starts}
    for step in range(max(ks)):
        known = {s: np.array(c) for s, c in drawn.items() if len(c) == step}
        for s, x in (_next_centres(table, known, step) if known else {}).items():
            drawn[s].append(x)
    moving = {(k, s): np.array(drawn[s][:k]) for k in ks for s in starts if drawn[s]}
    if not moving:
        scratch.drop(table)
        return {}
    width = next(iter(moving.values())).shape[1]
    spread = table.agg(*[F.var_pop(F.col("x")[j]) for j in range(width)]).first()
    limit, done = tolerance * float(np.mean(spread)), {}
    for _ in range(max_iter):
        moved = {}
        for name, (n, sums, _) in _pass(table, moving).items():
            after = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], moving[name])
            (done if ((after - moving[name]) ** 2).sum() <= limit else moved)[name] = after
        moving = moved
        if not moving:
            break
    done |= moving
    out = {name: Centres(done[name], float(cost.sum())) for name, (_, _, cost) in _pass(table, done).items()}
    scratch.drop(table)
    return out


def best(fitted: dict[tuple[int, int], Centres], k: int) -> Centres:
    """The model of k groups with the least cost (ties: the lower start)."""
    return min(((s, m) for (n, s), m in fitted.items() if n == k), key=lambda found: (found[1].cost, found[0]))[1]
