"""Return-risk classifiers on COD orders, and what is built on them.

* :func:`feature_stages` -- scale 7 numbers (mean 0, sd 1) and one-hot 5 categories
  (all seen levels kept, unseen or NULL levels -> all zeros), for KNN.
* :func:`fit_predict` -- logistic regression (L2, C = 1, balanced) is in ``gram``, the depth-6
  tree (balanced) in ``exact_tree``, the forest of 300 depth-12 trees (balanced) in ``forest``,
  gradient boosting (100 rounds of depth-3 trees, step 0.1, Newton leaves) in ``boosting``; KNN
  (k = 25) is the exact blocked scorer in ``knn``.
* :func:`train_models` -- stratified hold-out, fit all five, one metrics row per model.
* :func:`oof_scores` -- out-of-fold risk for every order (fit on four folds, score the
  fifth), mapped to the 300-900 score.
* :func:`importances`, :func:`batch_score`, :func:`cv_auc`, :func:`class_weights`.

The design frame is persisted once per call chain and unpersisted once the predictions
are written as tables; all boosted models (folds, hold-out) grow in the same scans; other
independent fits run concurrently (``parallel_fits``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelwise.functions.exprs import score_from_risk
from parcelwise.operators import exact_tree as T
from parcelwise.operators import metrics as M
from parcelwise.operators.boosting import Booster, fit_boosters
from parcelwise.operators.forest import Forest, fit_forest
from parcelwise.operators.gram import Linear, logistic
from parcelwise.operators.parallel_fits import run_concurrently
from parcelwise.operators.knn import knn_scores
from parcelwise.operators.windows import split_and_folds
from parcelwise.sources.scratch import Scratch
from parcelwise.sources.store import materialize

# The model inputs (all knowable before dispatch) and the model names.
NUM_FEATS = ["OrderValue", "DiscountPct", "PriorOrders", "PriorRTORate", "FirstTime",
             "OrderHour", "Items"]
CAT_FEATS = ["CityTier", "State", "Category", "Device", "AddressQuality"]
MODEL_NAMES = ["Logistic Regression", "KNN", "Decision Tree", "Random Forest", "Gradient Boosting"]
SCORE_MODEL = "Gradient Boosting"


def design(df: DataFrame, num: Sequence[str] = NUM_FEATS, cat: Sequence[str] = CAT_FEATS,
           label: str = "RTO", id_col: str = "OrderID", extra: Sequence[str] = ()) -> DataFrame:
    """id, numeric features as double, categorical features, label, extras. A missing number
    stays NULL here; ``feature_stages`` fills it with the training rows' median."""
    return df.select(id_col, *[F.col(c).cast("double").alias(c) for c in num],
                     *[F.col(c).cast("string").alias(c) for c in cat], F.col(label).cast("int").alias(label),
                     *extra)


def feature_stages(num: Sequence[str] = NUM_FEATS, cat: Sequence[str] = CAT_FEATS,
                   out: str = "features") -> list:
    idx = [f"{c}__idx" for c in cat]
    vec = [f"{c}__vec" for c in cat]
    return [
        StringIndexer(inputCols=list(cat), outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        # dropLast drops the extra 'unseen' slot of handleInvalid=keep: seen levels all kept
        OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True),
        Imputer(inputCols=list(num), outputCols=[f"{c}__full" for c in num], strategy="median"),
        VectorAssembler(inputCols=[f"{c}__full" for c in num], outputCol="__num"),
        StandardScaler(inputCol="__num", outputCol="__num_z", withMean=True, withStd=True),
        VectorAssembler(inputCols=["__num_z", *vec], outputCol=out),
    ]


def class_weights(df: DataFrame, label: str = "RTO") -> DataFrame:
    """(label, n, weight) with balanced weights n_total / (2 * n_class)."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("weight", total / (F.lit(2.0) * F.col("n"))))


Model = Booster | Forest | T.Tree | Linear


def predict(model: Model, rows: DataFrame, label: str = "RTO", id_col: str = "OrderID",
            extra: Sequence[str] = ()) -> DataFrame:
    """id, label, further columns, Risk and prediction of design rows by a fitted model."""
    keep = [id_col, label, *extra]
    if isinstance(model, (Booster, Forest)):
        return model.predict(rows, keep)
    risk = T.risk(model) if isinstance(model, T.Tree) else model.risk()
    scored = rows.select(*keep, risk.alias("Risk"))
    return scored.withColumn("prediction", (F.col("Risk") > 0.5).cast("double"))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """The kind of model and the model itself, below ``path``."""
    spark.createDataFrame([(type(model).__name__,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")
    model.save(spark, f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    kind = spark.read.parquet(f"{path}/kind").first()["kind"]
    return {"Booster": Booster, "Forest": Forest, "Tree": T.Tree, "Linear": Linear}[kind].load(spark, f"{path}/model")


def fit_predict(train: DataFrame, tests: Sequence[DataFrame], name: str, seed: int = 42,
                label: str = "RTO", id_col: str = "OrderID"):
    """Fit ``name`` on ``train``; return (model or None, [predictions of each test frame])
    with columns id, label, Risk, prediction."""
    if name == "KNN":
        feat = Pipeline(stages=feature_stages()).fit(train)
        tr = feat.transform(train).select(F.col(id_col).alias("tid"), vector_to_array("features").alias("x"),
                                          F.col(label).alias("y"))
        outs = []
        for t in tests:
            te = feat.transform(t).select(id_col, label, vector_to_array("features").alias("x"))
            sc = knn_scores(tr, te, k=25, query_id=id_col)
            outs.append(te.join(sc, id_col).select(id_col, label, F.col("prob").alias("Risk"),
                                                  F.col("pred").cast("double").alias("prediction")))
        return feat, outs
    if name == "Gradient Boosting":
        (model,), _ = fit_boosters(train, [F.lit(True)], NUM_FEATS, CAT_FEATS, label, [id_col])
        return model, [predict(model, t, label, id_col) for t in tests]
    if name == "Decision Tree":
        model = T.grow(train, NUM_FEATS, CAT_FEATS, label)
        return model, [predict(model, t, label, id_col) for t in tests]
    if name == "Logistic Regression":
        (model,) = logistic(train, [F.lit(True)], NUM_FEATS, CAT_FEATS, label)
        return model, [predict(model, t, label, id_col) for t in tests]
    if name == "Random Forest":
        model = fit_forest(train, NUM_FEATS, CAT_FEATS, label, [id_col], seed=seed)
        return model, [predict(model, t, label, id_col) for t in tests]
    raise ValueError(f"unknown model {name!r}")


def _metrics_row(name: str, pred_test: DataFrame, pred_train: DataFrame, label: str = "RTO") -> DataFrame:
    p = pred_test.withColumn("Pred", F.col("prediction").cast("int"))
    tm = M.threshold_metrics(p, label, "Pred")
    auc = M.auc(p, label, "Risk").scalar()
    train_acc = pred_train.agg(F.avg((F.col(label) == F.col("prediction").cast("int")).cast("double"))).scalar()
    mean_p = p.agg(F.avg("Risk")).scalar()
    return tm.select(F.lit(name).alias("model"), F.round(train_acc, 6).alias("train_acc"),
                     F.col("accuracy").alias("test_acc"), "precision", "recall", "f1",
                     auc.alias("roc_auc"),
                     F.round(train_acc - F.col("accuracy"), 6).alias("overfit_gap"),
                     F.round(mean_p, 6).alias("mean_predicted"))


def train_models(cod: DataFrame, models: Sequence[str] = MODEL_NAMES, seed: int = 42, test_share: float = 0.25,
                 fitted: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """One metrics row per model on a stratified hold-out of ``cod``. ``fitted`` has (test,
    training) predictions of models that were fitted on the same split before."""
    d = split_and_folds(design(cod), "RTO", "OrderID", seed=seed, test_share=test_share)
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    train, test = d.where("is_test = 0"), d.where("is_test = 1")
    spark = cod.sparkSession

    def fit_one(name):
        if fitted and name in fitted:
            return name, *fitted[name]
        _, (pt, ptr) = fit_predict(train, [test, train], name, seed)
        # predictions are written once to the shared folder; every metric reads that
        # table instead of re-running the model (KNN scoring, 300 trees) per metric
        tag = name.replace(" ", "_").lower()
        pt = materialize(spark, pt, f"pred_test_{tag}")
        ptr = materialize(spark, ptr, f"pred_train_{tag}")
        return name, pt, ptr

    # the five fits are independent: their jobs run side by side
    rows = [_metrics_row(n, pt, ptr) for n, pt, ptr in run_concurrently(fit_one, models)]
    d.unpersist()  # metrics read the prediction tables only
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Rounded to 3 decimals, with the best model per metric flagged (max over 5 rows)."""
    cols = ["test_acc", "precision", "recall", "f1", "roc_auc"]
    m = metrics.select("model", *[F.round(c, 3).alias(c) for c in cols + ["overfit_gap"]])
    every = Window.partitionBy()  # one row per model: five rows
    for c in cols + ["overfit_gap"]:
        m = m.withColumn(f"best_{c}", F.col(c) == F.max(c).over(every))
    return m


def boosted(d: DataFrame, n_folds: int = 5, label: str = "RTO", id_col: str = "OrderID") -> tuple[Booster, DataFrame]:
    """Of ``split_and_folds`` rows, in one pass: the booster of the training rows, and a table of
    every row's ``Risk`` by it and ``FoldRisk`` by the booster of the other folds."""
    members = [F.col("fold") != k for k in range(n_folds)] + [F.col("is_test") == 0]
    fitted, out = fit_boosters(d, members, NUM_FEATS, CAT_FEATS, label, [id_col, label, "fold", "is_test"])
    risks = F.col("risks")
    return fitted[n_folds], out.select(id_col, label, "fold", "is_test", risks[n_folds].alias("Risk"),
                                       F.element_at(risks, F.col("fold") + 1).alias("FoldRisk"))


def out_of_fold(rows: DataFrame) -> DataFrame:
    return rows.select("OrderID", "RTO", "fold", F.col("FoldRisk").alias("Risk"),
                       score_from_risk("FoldRisk").alias("Score"))


def oof_scores(cod: DataFrame, name: str = SCORE_MODEL, seed: int = 42, n_folds: int = 5) -> DataFrame:
    """Out-of-fold Risk and Score for every order: fold k is scored by a model fitted on
    the other folds, so no order is scored by a model that saw it."""
    d = split_and_folds(design(cod), "RTO", "OrderID", seed=seed, n_folds=n_folds)
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    if name == SCORE_MODEL:
        _, rows = boosted(d, n_folds)
        d.unpersist()  # the boosters' rows are a table
        return out_of_fold(rows)

    def fold(k):
        _, (p,) = fit_predict(d.where(F.col("fold") != k), [d.where(F.col("fold") == k)], name, seed)
        p = materialize(d.sparkSession, p, f"oof_{k}")
        return p.withColumn("fold", F.lit(k))

    parts = run_concurrently(fold, range(n_folds))
    d.unpersist()  # the fold predictions are tables now
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out_of_fold(out.withColumnRenamed("Risk", "FoldRisk"))


def importances(cod: DataFrame, name: str = SCORE_MODEL, seed: int = 42, top: int = 12,
                model: Model | None = None) -> DataFrame:
    """(feature, importance) of the fitted tree ensemble, expanded one-hot names."""
    d = design(cod)
    model = model or fit_predict(d, [], name, seed)[0]
    df = cod.sparkSession.createDataFrame(model.importances(), "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)


def batch_score(cod: DataFrame, new_orders: DataFrame, name: str = SCORE_MODEL, seed: int = 42,
                model_path: str | None = None, low: int = 580, high: int = 720,
                model: Model | None = None) -> DataFrame:
    """Fit once on ``cod`` (unless a fitted ``model`` is given), save the model to the shared
    folder, load it back and score ``new_orders``. Columns they lack are filled: hour 20,
    1 item, the most common state."""
    model = model or fit_predict(design(cod), [], name, seed)[0]
    path = model_path or Scratch(cod.sparkSession, "model").path(name.replace(" ", "_").lower())
    save_model(cod.sparkSession, model, path)
    loaded = load_model(cod.sparkSession, path)
    mode_state = (cod.groupBy("State").agg(F.count(F.lit(1)).alias("n"))
                     .agg(F.min_by("State", F.struct(-F.col("n"), F.col("State")))).scalar())
    filled = new_orders
    for c, v in (("OrderHour", F.lit(20)), ("Items", F.lit(1)), ("State", mode_state)):
        filled = filled.withColumn(c, F.coalesce(F.col(c), v) if c in filled.columns else v)
    if "PriorRTORate" not in filled.columns:
        filled = filled.withColumn("PriorRTORate", F.when(F.col("PriorOrders") > 0,
                                   F.least(F.col("PriorReturns"), F.col("PriorOrders")) / F.col("PriorOrders"))
                                   .otherwise(F.lit(0.0)))
    if "FirstTime" not in filled.columns:
        filled = filled.withColumn("FirstTime", (F.col("PriorOrders") == 0).cast("int"))
    if "RTO" not in filled.columns:
        filled = filled.withColumn("RTO", F.lit(0))
    scored = predict(loaded, design(filled))
    score = score_from_risk("Risk")
    tier = (F.when(score >= high, F.lit("Free COD")).when(score < low, F.lit("Prepaid-only"))
            .otherwise(F.lit("COD + fee")))
    return scored.select("OrderID", F.round("Risk", 6).alias("Risk"), score.alias("Score"), tier.alias("Tier"))


# The learnability check's inputs (a plain logistic model, 4 folds).
CV_NUM = ["OrderValue", "DiscountPct", "PriorRTORate", "FirstTime", "PriorOrders"]
CV_CAT = ["CityTier", "Category", "AddressQuality", "Device"]


def cv_auc(cod: DataFrame, n_folds: int = 4, seed: int = 42) -> DataFrame:
    """Mean and sd of the held-out AUC of an unweighted logistic model over k folds. The models of
    all folds are fitted together; numbers are left as they are, a missing level is a level."""
    rows = design(cod, CV_NUM, CV_CAT).fillna("NA", CV_CAT)
    spark = cod.sparkSession
    d = materialize(spark, split_and_folds(rows, "RTO", "OrderID", seed=seed, n_folds=n_folds), "cv_rows")
    fitted = logistic(d, [F.col("fold") != k for k in range(n_folds)], CV_NUM, CV_CAT, balanced=False, scale=False)
    risk = F.coalesce(*[F.when(F.col("fold") == k, m.risk()) for k, m in enumerate(fitted)])
    scored = materialize(spark, d.select("RTO", "fold", risk.alias("Risk")), "cv_scores")

    def fold_auc(k):
        return materialize(spark, M.auc(scored.where(F.col("fold") == k), "RTO", "Risk").withColumn("fold", F.lit(k)), "fold_auc")

    aucs = run_concurrently(fold_auc, range(n_folds))
    out = aucs[0]
    for a in aucs[1:]:
        out = out.unionByName(a)
    return out.agg(F.round(F.avg("auc"), 6).alias("mean_auc"), F.round(F.stddev_pop("auc"), 6).alias("sd_auc"),
                   F.count(F.lit(1)).alias("folds"))
