"""Model inputs: missing numbers filled with the training median, levels as codes.

``Encoding`` is fitted on training rows: exact medians of the number columns that have NULLs, and
the sorted levels of the category columns. Unseen and NULL levels belong to no level (code -1).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import metrics as M


SCHEMA = "num array<string>, cat array<string>, medians array<double>, levels array<array<string>>"


@dataclass(frozen=True)
class Encoding:
    num: tuple[str, ...]
    cat: tuple[str, ...]
    medians: tuple[float, ...]
    levels: tuple[tuple[str, ...], ...]

    @staticmethod
    def fit(train: DataFrame, num: Sequence[str], cat: Sequence[str]) -> Encoding:
        row = train.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(num)],
                        *[F.sort_array(F.collect_set(F.col(c))).alias(f"l{i}") for i, c in enumerate(cat)]).first()
        medians = [M.exact_quantiles(train, c, [0.5])[0] or 0.0 if row[f"n{i}"] else 0.0 for i, c in enumerate(num)]
        return Encoding(tuple(num), tuple(cat), tuple(medians), tuple(tuple(row[f"l{i}"]) for i in range(len(cat))))

    def row(self) -> tuple:
        """As a row of ``SCHEMA``, to save with a model."""
        return list(self.num), list(self.cat), list(self.medians), [list(x) for x in self.levels]

    @staticmethod
    def of(row) -> Encoding:
        return Encoding(tuple(row["num"]), tuple(row["cat"]), tuple(row["medians"]), tuple(tuple(x) for x in row["levels"]))

    def numbers(self) -> list[Column]:
        return [F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(f"x{i}")
                for i, (c, m) in enumerate(zip(self.num, self.medians))]

    def codes(self) -> list[Column]:
        """0-based level numbers as ``c0``, ``c1``, ...; -1 for none of the levels."""
        def code(c: str, known: tuple[str, ...]) -> Column:
            if not known:
                return F.lit(-1)
            at = F.array_position(F.array(*[F.lit(v) for v in known]), F.col(c))
            return F.coalesce(at, F.lit(0)).cast("int") - 1
        return [code(c, known).alias(f"c{i}") for i, (c, known) in enumerate(zip(self.cat, self.levels))]

    def feature_names(self) -> list[str]:
        """One name per number and per level (``column=level``)."""
        return list(self.num) + [f"{c}={v}" for c, known in zip(self.cat, self.levels) for v in known]
