"""Score order exports as they arrive.

The reference scores one order at a time from a form; on a cluster the same step is a
stream: new CSV exports land in a folder, each micro-batch is cleaned with the batch
cleaning steps that are row-local, scored by the saved model (fitted once by
``models.fit_predict`` and saved by ``save_scorer``) and tiered. Nothing here keeps state
across micro-batches, so no watermark is needed; the sink's checkpoint (in the shared
checkpoint folder) gives exactly-once file output after a restart.

Cross-row cleaning needs the whole table: the median that replaces impossible discounts is
the one of the rows the model was fitted on, saved beside the model, so that an order gets the
same score in the stream as in a batch. Exact copies are left to the batch clean-up (a global
streaming de-duplication would keep every order id in state forever).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.functions.exprs import null_tokens_to_null, score_from_risk
from parcelwise.operators import clean as C
from parcelwise.operators.models import Model, design, load_model, predict, save_model
from parcelwise.operators.policy import tier_expr
from parcelwise.sources.io import RAW_SCHEMA


def read_order_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(RAW_SCHEMA).option("header", "true")
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .option("escape", "\"").option("multiLine", "true").option("enforceSchema", "false")
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))


def save_scorer(model: Model, batch_raw: DataFrame, path: str) -> None:
    """The fitted model and the discount median of the batch it was fitted on."""
    save_model(batch_raw.sparkSession, model, f"{path}/scorer")
    parsed = C.dedup(batch_raw).transform(C.parse_value).transform(C.parse_discount)
    C.discount_median(parsed).withColumnRenamed("__disc_median", "discount_median").coalesce(1) \
        .write.parquet(f"{path}/discount_median")


def clean_stream(raw: DataFrame, discount_median: float | None) -> DataFrame:
    """Row-local cleaning: parse, cap discounts at the saved median, normalise, fill, flags."""
    texts = [f.name for f in raw.schema.fields if f.dataType.simpleString() == "string"]
    raw = raw.withColumns({c: null_tokens_to_null(c) for c in texts})
    capped = F.when(F.col("DiscountPct") > 100, F.lit(discount_median).cast("double")).otherwise(F.col("DiscountPct"))
    df = (C.schema_guard(raw).transform(C.parse_value).transform(C.parse_discount)
          .withColumn("DiscountPct", capped).transform(C.normalise_tier).transform(C.normalise_state)
          .transform(C.fill_unknown).transform(C.add_flags).transform(C.drop_null_value))
    return df


def score_stream(raw: DataFrame, path: str, low: int = 580, high: int = 720) -> DataFrame:
    """COD orders of the stream with Risk, Score and Tier from what ``save_scorer`` wrote."""
    model = load_model(raw.sparkSession, f"{path}/scorer")
    median = raw.sparkSession.read.parquet(f"{path}/discount_median").first()["discount_median"]
    cod = clean_stream(raw, median).where(F.col("IsCOD") == 1)
    scored = predict(model, design(cod, extra=["CustomerID"]), extra=["CustomerID"])
    out = scored.select("OrderID", "CustomerID", F.round("Risk", 6).alias("Risk"),
                        score_from_risk("Risk").alias("Score"))
    return out.withColumn("Tier", tier_expr("Score", low, high))
