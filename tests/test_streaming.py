import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001


def test_score_stream_matches_batch_model(spark):
    from parcelwise.operators import models as ML
    from parcelwise.plans import data
    from parcelwise.sources import io as IO
    from parcelwise.streaming.scoring import read_order_stream, save_scorer, score_stream

    work = tempfile.mkdtemp(prefix="pw-stream-")
    model_path = os.path.join(work, "scorer")
    raw, cod = data.raw(spark, SF001), data.cod(spark, SF001)
    model, (batch,) = ML.fit_predict(ML.design(cod), [ML.design(cod)], "Logistic Regression")
    save_scorer(model, raw, model_path)
    inbox = os.path.join(work, "inbox")
    IO.write_orders_csv(raw.where(F.coalesce(F.col("OrderDay"), F.lit(0)) < 1000), os.path.join(inbox, "a"))
    IO.write_orders_csv(raw.where(F.col("OrderDay") >= 1000), os.path.join(inbox, "b"))
    stream = score_stream(read_order_stream(spark, os.path.join(inbox, "*")), model_path)
    q = (stream.writeStream.format("memory").queryName("scored_orders")
         .option("checkpointLocation", os.path.join(work, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = spark.table("scored_orders")
    n_cod = raw.where("PaymentMethod = 'COD' AND OrderValue <> 'on request'").count()
    assert out.count() == n_cod                      # every COD row of both files scored once
    want = {r.OrderID: round(r.Risk, 6) for r in batch.collect()}
    assert all(abs(want[r.OrderID] - r.Risk) < 1e-6 for r in out.collect())  # row by row
    assert out.where("Score < 300 OR Score > 900").count() == 0
    assert set(r.Tier for r in out.select("Tier").distinct().collect()) <= {"Free COD", "COD + fee", "Prepaid-only"}
