"""Upper-tail chi-square probability, as a vectorised pandas UDF.

Spark SQL has no chi-square distribution function. The p-value is only ever needed on
a handful of rows (one per clue), after all heavy lifting is done by aggregates, so a
small numeric helper on Arrow batches is the right tool.

Q(a, x) (the regularised upper incomplete gamma) uses the series for x < a + 1 and a
continued fraction otherwise (standard Lentz evaluation); p = Q(dof / 2, chi2 / 2).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_MAX_ITER = 10_000


def _lower_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    ap = a
    for _ in range(_MAX_ITER):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _upper_fraction(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAX_ITER):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        if abs(d) < _TINY:
            d = _TINY
        c = b + an / c
        if abs(c) < _TINY:
            c = _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float | None, dof: float | None) -> float | None:
    """P(X > x) for X ~ chi-square(dof); dof 0 gives 1.0 (no test), as SciPy does."""
    if x is None or dof is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if dof <= 0:
        return 1.0
    if x <= 0:
        return 1.0
    if dof == 1:
        return math.erfc(math.sqrt(x / 2.0))
    a, h = dof / 2.0, x / 2.0
    if h < a + 1.0:
        return max(0.0, 1.0 - _lower_series(a, h))
    return _upper_fraction(a, h)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(None if pd.isna(a) else float(a),
                              None if pd.isna(b) else float(b)) for a, b in zip(x, dof)],
                     dtype="float64")
