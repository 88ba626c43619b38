"""Gaussian mixtures of several starts in the same scans.

Each start begins with the groups of a K-Means model (``lloyd``): their rows count fully for their own
component. A pass then reads the rows once for all starts that still move and adds up, per
component, the memberships, the weighted columns and the weighted products of two columns, which
give the next weights, means and covariances. A start stops when the mean log-likelihood of two
passes differs by less than ``tolerance``.

Every row's share is rounded to a whole multiple of 2^-40 and added as two integers, so models do not
depend on how the rows are partitioned. What reaches the driver are these sums: starts x components x
(1 + columns + pairs of columns) numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators.lloyd import FILE_ROWS, Centres, squared
from parcelwise.sources.scratch import Scratch

# The reference learner's defaults.
TOLERANCE, MAX_ITER, COVARIANCE_FLOOR = 1e-3, 100, 1e-6
_BITS, _LOW = 40, 24
#: Rows whose shares are computed at a time.
SLICE = 4096


@dataclass(frozen=True)
class Mixture:
    """Fitted components: ``weights`` (k), ``means`` (k x d), ``covariances`` (k x d x d), and the mean
    log-likelihood of the rows under them."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihood: float

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Per component the upper-triangular factor U of the inverse covariance (U U'), and the
        constant of the log density, the weight included."""
        d = self.means.shape[1]
        factors = np.stack([np.linalg.inv(np.linalg.cholesky(c)).T for c in self.covariances])
        logs = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        with np.errstate(divide="ignore"):
            return factors, np.log(self.weights) + logs - d * np.log(2 * np.pi) / 2

    def memberships(self, x: Column) -> Column:
        """Array column: the membership of each component, for an array column of coordinates."""
        factors, constants = self.whitening()

        def density(k: int) -> Column:
            out = F.lit(float(constants[k]))
            for j in range(factors.shape[2]):
                y = sum(((x[i] - F.lit(float(self.means[k, i]))) * F.lit(float(factors[k, i, j])) for i in range(j + 1)),
                        F.lit(0.0))
                out = out - y * y / 2
            return out
        densities = F.array(*[density(k) for k in range(len(constants))])
        # e^(l - max) first, so that no exponential overflows
        bound = F.transform(F.array(densities), lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a))))[0]
        return F.transform(F.array(bound), lambda a: F.transform(
            a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, w: s + w)))[0]


def log_densities(x: np.ndarray, mixture: Mixture) -> np.ndarray:
    """Log density times weight, rows x components, added up column by column in a fixed order."""
    factors, constants = mixture.whitening()
    out = np.tile(constants, (len(x), 1))
    for k in range(len(constants)):
        away = x - mixture.means[k]
        for j in range(x.shape[1]):
            y = np.zeros(len(x))
            for i in range(j + 1):
                y += away[:, i] * factors[k, i, j]
            out[:, k] -= y * y / 2
    return out


def shares(x: np.ndarray, mixture: Mixture) -> tuple[np.ndarray, np.ndarray]:
    """Memberships (rows x components) and the log-likelihood of each row."""
    logs = log_densities(x, mixture)
    top = logs.max(axis=1)
    parts = np.exp(logs - top[:, None])
    total = parts[:, 0].copy()
    for k in range(1, parts.shape[1]):
        total += parts[:, k]
    return parts / total[:, None], top + np.log(total)


def _own_group(centres: Centres) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    def share(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = squared(x, centres.points).argmin(axis=1)
        return (own[:, None] == np.arange(len(centres.points))).astype(float), np.zeros(len(x))
    return share


def _under(mixture: Mixture) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    return lambda x: shares(x, mixture)


def _pass(table: DataFrame, share: Mapping[int, Callable], width: int, k: Mapping[int, int]) -> dict[int, tuple[np.ndarray, float]]:
    """Per start the sums of each component (memberships, columns, products) and of the log-likelihood."""
    one, two = np.triu_indices(width)
    cells = 1 + width + len(one)
    first = dict(zip(share, np.cumsum([0, *[k[s] * cells + 1 for s in share]]).tolist()))
    size = sum(k[s] * cells + 1 for s in share)

    def run(batches):
        sums = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            every = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width))
            for at in range(0, len(every), SLICE):
                x = every[at:at + SLICE]
                terms = np.hstack([np.ones((len(x), 1)), x, x[:, one] * x[:, two]])
                sums = np.zeros((2, size), dtype=np.int64) if sums is None else sums
                for start, of in share.items():
                    member, likelihood = of(x)
                    values = np.hstack([*[member[:, [c]] * terms for c in range(k[start])], likelihood[:, None]])
                    whole = np.rint(values * float(1 << _BITS))
                    high = np.floor(whole / (1 << _LOW))
                    place = slice(first[start], first[start] + values.shape[1])
                    sums[0, place] += high.astype(np.int64).sum(axis=0)
                    sums[1, place] += (whole - high * (1 << _LOW)).astype(np.int64).sum(axis=0)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums[0]), pa.array(sums[1])],
                                             names=["place", "high", "low"])
    added = table.mapInArrow(run, "place long, high long, low long").groupBy("place").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    sums = np.zeros(size)
    for r in added.collect():  # one a sum
        sums[r["place"]] = ((int(r["high"]) << _LOW) + int(r["low"])) / (1 << _BITS)
    return {s: (sums[a:a + k[s] * cells].reshape(k[s], cells), float(sums[a + k[s] * cells])) for s, a in first.items()}


def _components(sums: np.ndarray, width: int, likelihood: float) -> Mixture:
    """Weights, means and covariances of the sums; a component without rows gets the floor alone."""
    one, two = np.triu_indices(width)
    n = sums[:, 0] + 10 * np.finfo(float).eps
    means = sums[:, 1:1 + width] / n[:, None]
    covariances = np.zeros((len(n), width, width))
    covariances[:, one, two] = sums[:, 1 + width:] / n[:, None] - means[:, one] * means[:, two]
    covariances[:, two, one] = covariances[:, one, two]
    covariances[:, range(width), range(width)] += COVARIANCE_FLOOR
    return Mixture(n / n.sum(), means, covariances, likelihood)


def fit(rows: DataFrame, starts: Mapping[int, Centres], features: str = "features", tolerance: float = TOLERANCE,
        max_iter: int = MAX_ITER) -> dict[int, Mixture]:
    """Mixtures per start, with as many components as the start's K-Means model has groups. All rows
    count, repeated ones too; rows must have no null. No starts or no rows give no models."""
    if not starts:
        return {}
    scratch = Scratch(rows.sparkSession, "mixture")
    table = scratch.dealt(rows.select(vector_to_array(features).alias("x")), "points", FILE_ROWS)
    n, k = table.count(), {s: len(c.points) for s, c in starts.items()}
    if not n:
        scratch.drop(table)
        return {}
    width = next(iter(starts.values())).points.shape[1]
    made = {s: _components(sums, width, -np.inf)
            for s, (sums, _) in _pass(table, {s: _own_group(c) for s, c in starts.items()}, width, k).items()}
    moving, done = made, {}
    for _ in range(max_iter):
        after = {s: _components(sums, width, total / n)
                 for s, (sums, total) in _pass(table, {s: _under(m) for s, m in moving.items()}, width, k).items()}
        done |= {s: m for s, m in after.items() if abs(m.likelihood - moving[s].likelihood) < tolerance}
        moving = {s: m for s, m in after.items() if s not in done}
        if not moving:
            break
    done |= moving
    scratch.drop(table)
    return done


def best(fitted: Mapping[int, Mixture]) -> Mixture:
    """The mixture with the highest mean log-likelihood in its last pass (ties: the lower start)."""
    return min(fitted.items(), key=lambda found: (-found[1].likelihood, found[0]))[1]
