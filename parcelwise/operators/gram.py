"""Linear models from sums of products: least squares, ridge, lasso, and logistic regression.

A row's input vector is an intercept, its numbers (centred and scaled by all rows, for the sake of
the arithmetic only) and one 0/1 entry per level. Tasks add up the products of all pairs of
entries; one grouped sum merges them, so a fit needs a matrix of (inputs + 2)^2 numbers, whatever
the number of rows.

* ``grams``: one matrix per group of rows in one scan; the matrix of "all but fold k" is a
  difference. Least squares (smallest coefficients among equals), ridge and lasso (coordinate
  descent) are solved on it.
* ``logistic``: Newton steps; one scan a step serves all models (folds, hold-out). The penalty is
  half the squared norm of the coefficients (C = 1), on numbers scaled by each model's own training
  rows or left as they are; the intercept is free.

The fitted models are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.operators.encoding import SCHEMA as ENCODING
from parcelwise.operators.encoding import Encoding
from parcelwise.sources.scratch import Scratch

NEWTON_STEPS, TOLERANCE = 50, 1e-9


@dataclass
class Scaled:
    """An encoding and the means and deviations that its numbers are centred and scaled by."""

    encoding: Encoding
    mean: np.ndarray
    sd: np.ndarray

    @property
    def size(self) -> int:
        return 1 + len(self.mean) + sum(map(len, self.encoding.levels))

    def columns(self) -> list[Column]:
        return [*self.encoding.numbers(), *self.encoding.codes()]

    def vector(self) -> Column:
        """The input vector without the intercept, as an array column."""
        enc = self.encoding
        scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(float(mean))) / F.lit(float(sd))
                  for c, m, mean, sd in zip(enc.num, enc.medians, self.mean, self.sd)]
        return F.concat(F.array(*scaled).cast("array<double>"), one_hot(enc))

    def matrix(self, columns: list[pa.Array]) -> np.ndarray:
        """Input vectors of a batch of ``columns()``."""
        n_num, n = len(self.mean), len(columns[0])
        out = np.zeros((n, self.size))
        out[:, 0] = 1.0
        at = 1 + n_num
        for j in range(n_num):
            out[:, 1 + j] = (columns[j].to_numpy(zero_copy_only=False) - self.mean[j]) / self.sd[j]
        for known, codes in zip(self.encoding.levels, columns[n_num:]):
            code = codes.to_numpy(zero_copy_only=False)
            some = np.flatnonzero(code >= 0)
            out[some, at + code[some]] = 1.0
            at += len(known)
        return out


@dataclass
class Linear:
    """A fitted linear model: ``column()`` is intercept + weights times the scaled inputs."""

    inputs: Scaled
    weights: np.ndarray

    def column(self) -> Column:
        enc, w = self.inputs.encoding, [float(x) for x in self.weights]
        out, at = F.lit(w[0]), 1
        for j, (c, m) in enumerate(zip(enc.num, enc.medians)):
            z = (F.coalesce(F.col(c).cast("double"), F.lit(m)) - F.lit(float(self.inputs.mean[j]))) / F.lit(float(self.inputs.sd[j]))
            out = out + F.lit(w[at]) * z
            at += 1
        for code, known in zip(enc.codes(), enc.levels):
            if known:  # models of the same inputs look a level's place up together
                out = out + F.coalesce(F.get(F.array(*map(F.lit, w[at:at + len(known)])), code), F.lit(0.0))
                at += len(known)
        return out

    def risk(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.column()))

    def save(self, spark: SparkSession, path: str) -> None:
        row = ([float(x) for x in self.weights], [float(x) for x in self.inputs.mean], [float(x) for x in self.inputs.sd],
               *self.inputs.encoding.row())
        schema = f"weights array<double>, mean array<double>, sd array<double>, {ENCODING}"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Linear:
        r = spark.read.parquet(path).first()
        return Linear(Scaled(Encoding.of(r), np.array(r["mean"]), np.array(r["sd"])), np.array(r["weights"]))

    def coefficients(self) -> dict[str, float]:
        """On the numbers as they are: intercept and one weight per number and level."""
        n_num = len(self.inputs.mean)
        raw = self.weights[1:1 + n_num] / self.inputs.sd
        start = self.weights[0] - float(np.sum(raw * self.inputs.mean))
        names = self.inputs.encoding.feature_names()
        return {"intercept": float(start), **dict(zip(names, [*map(float, raw), *map(float, self.weights[1 + n_num:])]))}


def one_hot(enc: Encoding) -> Column:
    """0/1 per level of every category column, levels in order."""
    hot = [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
           for c, known in zip(enc.cat, enc.levels) for v in known]
    return F.array(*hot).cast("array<double>")


def scaled_inputs(rows: DataFrame, num: Sequence[str], cat: Sequence[str]) -> Scaled:
    enc = Encoding.fit(rows, num, cat)
    row = rows.select(*enc.numbers()).agg(
        *[f(f"x{i}").alias(f"{n}{i}") for i in range(len(num)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() \
        if num else {}
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(len(num))])
    return Scaled(enc, mean, np.array([row[f"s{i}"] or 1.0 for i in range(len(num))]))


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The cells of all tasks added up."""
    found = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(shape)


def _cells(sums: np.ndarray) -> pa.RecordBatch:
    flat = sums.ravel()
    some = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["cell", "value"])


def grams(rows: DataFrame, inputs: Scaled, target: str, group: Column, n_groups: int) -> np.ndarray:
    """Per group (0 .. n_groups - 1; other rows are left out) the sums of products of the input
    vectors and, as the last entry, the target."""
    known = rows.select(F.col(target).cast("double").alias("y"), group.cast("int").alias("grp"), *inputs.columns())
    known = known.where(F.col("y").isNotNull() & F.col("grp").between(0, n_groups - 1))
    size = inputs.size + 1

    def run(batches):
        sums = np.zeros((n_groups, size, size))
        for batch in batches:
            y, grp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            z = np.concatenate([inputs.matrix(batch.columns[2:]), y[:, None]], axis=1)
            for g in range(n_groups):
                mine = z[grp == g]
                sums[g] += mine.T @ mine
        yield _cells(sums)
    return _summed(known.mapInArrow(run, "cell long, value double"), (n_groups, size, size))


def _centred(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(products of the centred inputs, with the centred target, means of the inputs, of the target)."""
    n = max(gram[0, 0], 1.0)
    mean = gram[0] / n
    centred = gram - n * np.outer(mean, mean)
    return centred[1:-1, 1:-1], centred[1:-1, -1], mean[1:-1], float(mean[-1])


def _own_scale(inputs: Scaled, xx: np.ndarray, n: float) -> np.ndarray:
    """What multiplies each input to have deviation 1 on the rows of the matrix; levels stay."""
    scale = np.ones(len(xx))
    k = len(inputs.mean)
    sd = np.sqrt(np.maximum(np.diag(xx)[:k], 0.0) / max(n, 1.0))
    scale[:k] = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 1.0)
    return scale


def solve(inputs: Scaled, gram: np.ndarray, kind: str, alpha: float = 1.0) -> Linear:
    """``linear``, ``ridge`` (sum of squares + alpha |w|^2) or ``lasso`` (half the mean square +
    alpha |w|) of a matrix of ``grams``; numbers are scaled by the matrix's own rows first."""
    n = gram[0, 0]
    xx, xy, x_mean, y_mean = _centred(gram)
    scale = _own_scale(inputs, xx, n)
    a, b = xx * np.outer(scale, scale), xy * scale
    if kind == "linear":
        w = np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b
    elif kind == "ridge":
        w = np.linalg.solve(a + alpha * np.eye(len(a)), b)
    elif kind == "lasso":
        w = lasso(a, b, alpha * n)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    w = w * scale
    return Linear(inputs, np.concatenate([[y_mean - float(w @ x_mean)], w]))


def lasso(a: np.ndarray, b: np.ndarray, limit: float, rounds: int = 10_000) -> np.ndarray:
    """Coordinate descent on 1/2 w'aw - w'b + limit |w|."""
    w = np.zeros(len(b))
    used = np.flatnonzero(np.diag(a) > 1e-12)
    for _ in range(rounds):
        moved = 0.0
        for j in used:
            rest = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - limit, 0.0) / a[j, j]
            moved = max(moved, abs(new - w[j]))
            w[j] = new
        if moved < 1e-10 * max(1.0, float(np.abs(w).max())):
            break
    return w


def logistic(rows: DataFrame, members: Sequence[Column], num: Sequence[str], cat: Sequence[str], label: str = "RTO",
             balanced: bool = True, scale: bool = True) -> list[Linear]:
    """One model per condition in ``members``. ``balanced``: classes weigh n / (2 n_class);
    ``scale``: the penalty is on numbers of deviation 1 over the model's rows, else as they are."""
    if not 0 < len(members) <= 31:
        raise ValueError("between 1 and 31 models")
    scratch = Scratch(rows.sparkSession, "logistic")
    mask = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << m)).otherwise(F.lit(0)) for m, c in enumerate(members)),
               F.lit(0)).cast("int")
    known = rows.where(F.col(label).isNotNull()).withColumn("__members", mask).where("__members > 0")
    inputs = scaled_inputs(known, num, cat)
    given = scratch.table(known.select(F.col(label).cast("int").alias("y"), "__members", *inputs.columns()), "rows")
    hit = [F.col("__members").bitwiseAND(F.lit(1 << m)) != 0 for m in range(len(members))]
    row = given.agg(*[F.count_if(h & (F.col("y") == k)).alias(f"n{m}_{k}") for m, h in enumerate(hit) for k in (0, 1)],
                    *[F.stddev_pop(F.when(h, F.col(f"x{j}"))).alias(f"s{m}_{j}") for m, h in enumerate(hit)
                      for j in range(len(num))]).first()
    size, n_models = inputs.size, len(members)
    weights, penalty = np.ones((n_models, 2)), np.ones((n_models, size))
    for m in range(n_models):
        counts = [row[f"n{m}_{k}"] or 0 for k in (0, 1)]
        if balanced:
            weights[m] = [sum(counts) / (2.0 * c) if c else 1.0 for c in counts]
        for j in range(len(num)):
            own = (row[f"s{m}_{j}"] or inputs.sd[j]) if scale else 1.0
            penalty[m, 1 + j] = (own / inputs.sd[j]) ** 2
        penalty[m, 0] = 0.0
    beta, loss = np.zeros((n_models, size)), np.full(n_models, np.inf)
    step = np.zeros_like(beta)
    going = np.ones(n_models, dtype=bool)
    for _ in range(NEWTON_STEPS):
        hess, grad, now = _newton_sums(given, inputs, beta, weights)
        now = now + 0.5 * (penalty * beta * beta).sum(axis=1)
        for m in np.flatnonzero(going):
            if now[m] > loss[m] * (1 + 1e-12) + 1e-9:  # went too far: half the way back
                step[m] /= 2
                beta[m] -= step[m]
                continue
            loss[m] = now[m]
            free = hess[m] + np.diag(penalty[m])
            step[m] = np.linalg.pinv(free, rcond=1e-14, hermitian=True) @ (grad[m] - penalty[m] * beta[m])
            beta[m] += step[m]
            going[m] = np.abs(step[m]).max() > TOLERANCE
        if not going.any():
            break
    scratch.drop(given)
    return [Linear(inputs, b) for b in beta]


def _newton_sums(rows: DataFrame, inputs: Scaled, beta: np.ndarray, weights: np.ndarray):
    """Per model the weighted products, the gradient and the loss at ``beta``: one scan."""
    n_models, size = beta.shape

    def run(batches):
        sums = np.zeros((n_models, size + 1, size + 1))
        for batch in batches:
            y, members = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            z = inputs.matrix(batch.columns[2:])
            for m in range(n_models):
                mine = (members >> m) & 1 == 1
                x, target = z[mine], y[mine]
                margin = x @ beta[m]
                p = 1.0 / (1.0 + np.exp(-margin))
                w = weights[m][target]
                sums[m, :size, :size] += x.T @ (x * (w * p * (1 - p))[:, None])
                sums[m, size, :size] += x.T @ (w * (target - p))
                sums[m, size, size] += float((w * (np.logaddexp(0.0, margin) - target * margin)).sum())
        yield _cells(sums)
    found = _summed(rows.mapInArrow(run, "cell long, value double"), (n_models, size + 1, size + 1))
    return found[:, :size, :size], found[:, size, :size], found[:, size, size]
