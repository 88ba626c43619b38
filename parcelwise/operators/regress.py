"""Order-value regression: what sets basket size?

Four regressors (ordinary least squares, ridge alpha = 1, lasso alpha = 1, depth-6 tree) on a
25 % hold-out, scored by R^2 and MAE computed as SQL aggregates; plus the category-only baseline,
which is exactly the category mean on the training rows (a group-by joined back to the test rows).

The linear models are solved on one matrix of sums of products of the training rows (``gram``):
all three need a single scan. The tree has exact thresholds (``exact_tree``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.operators import exact_tree as T
from parcelwise.operators import gram as G
from parcelwise.operators.models import design
from parcelwise.operators.windows import split_and_folds
from parcelwise.sources.scratch import Scratch

# Regression inputs.
REG_NUM = ["DiscountPct", "Items", "OrderHour", "FirstTime", "PriorOrders"]
REG_CAT = ["Category", "CityTier", "Device", "AddressQuality", "PaymentMethod"]
REG_MODELS = ["Linear", "Ridge", "Lasso", "Decision Tree"]


def split(clean: DataFrame, seed: int = 42, test_share: float = 0.25) -> DataFrame:
    d = design(clean.withColumn("y", F.col("OrderValue").cast("double")), REG_NUM, REG_CAT,
               label="RTO", extra=["y"])
    return split_and_folds(d, None, "OrderID", seed=seed, test_share=test_share)


def r2_mae(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """R^2 = 1 - SSE / SST and MAE over a prediction frame (one aggregate)."""
    a = pred.agg(F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("sse"),
                 F.var_pop(y).alias("var"), F.count(y).alias("n"),
                 F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))
    sst = F.col("var") * F.col("n")  # not from raw squares, which cancel for large amounts
    return a.select(F.round(F.lit(1.0) - F.try_divide(F.col("sse"), sst), 6).alias("r2"),
                    F.round("mae", 6).alias("mae"))


def fit_regressors(train: DataFrame, models: Sequence[str] = REG_MODELS, alpha: float = 1.0) -> dict[str, Column]:
    """Each model's prediction as a column over the input columns."""
    out: dict[str, Column] = {}
    if set(models) - {"Decision Tree"}:
        inputs = G.scaled_inputs(train, REG_NUM, REG_CAT)
        (matrix,) = G.grams(train, inputs, "y", F.lit(0), 1)
    for name in models:
        if name == "Decision Tree":
            out[name] = T.mean(T.grow(train, REG_NUM, REG_CAT, "y", "squares"))
        else:
            out[name] = G.solve(inputs, matrix, name.lower(), alpha).column()
    return out


def regression_models(clean: DataFrame, models: Sequence[str] = REG_MODELS, seed: int = 42) -> DataFrame:
    """(model, r2, mae) on the hold-out."""
    scratch = Scratch(clean.sparkSession, "regress")
    d = scratch.table(split(clean, seed), "split")
    train, test = d.where("is_test = 0"), d.where("is_test = 1")
    fitted = fit_regressors(train, models)
    scored = scratch.table(test.select("y", *[p.alias(f"p{i}") for i, p in enumerate(fitted.values())]), "scored")
    rows = [r2_mae(scored, "y", f"p{i}").select(F.lit(name).alias("model"), "r2", "mae") for i, name in enumerate(fitted)]
    return scratch.table(reduce(DataFrame.unionByName, rows), "metrics")


def category_only(clean: DataFrame, seed: int = 42) -> DataFrame:
    """Test rows with p = mean OrderValue of their Category on the training rows (the
    least-squares fit on category dummies); unseen category -> training mean."""
    d = split(clean, seed)
    train, test = d.where("is_test = 0"), d.where("is_test = 1")
    means = train.groupBy("Category").agg(F.avg("y").alias("__cm"))
    overall = train.agg(F.avg("y")).scalar()
    return (test.join(means, "Category", "left")
                .select("OrderID", "Category", "y", F.coalesce("__cm", overall).alias("p")))
