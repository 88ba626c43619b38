import os
import tempfile

from parcelwise.sources import io as IO


def test_csv_null_tokens_and_padding_survive(spark):
    d = tempfile.mkdtemp(prefix="pw-io-")
    path = os.path.join(d, "orders.csv")
    header = ",".join(f.name for f in IO.RAW_SCHEMA.fields)
    rows = [
        "ORD1,CUST1,3,Tier 1,  goa ,A,\"Rs 1,299\",20%,COD,NA,Vague,5,1,0,0,Returned",
        "ORD2,CUST2,4,T2,GOA,A,999,10,Prepaid,,null,6,2,3,1,Delivered",
    ]
    with open(path, "w") as f:
        f.write(header + "\n" + "\n".join(rows) + "\n")
    got = {r.OrderID: r for r in IO.read_orders_csv(spark, path).collect()}
    assert got["ORD1"].Device is None and got["ORD2"].Device is None
    assert got["ORD2"].AddressQuality is None
    assert got["ORD1"].State == "  goa " and got["ORD1"].OrderValue == "Rs 1,299"
    assert got["ORD2"].PriorOrders == 3
    text = {r.OrderID: r for r in IO.read_text_csv(spark, path, IO.RAW_SCHEMA.names).collect()}
    assert text["ORD1"].Device == "NA"


def test_columns_by_header_quotes_and_optional(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="pw-io-")
    path = os.path.join(d, "orders.csv")
    header = ["DeliveryStatus", " orderid ", "PriorReturns", "PriorOrders", "PaymentMethod", "OrderValue", "Category", "extra"]
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        f.write('Returned,ORD1,1,2,COD,"Rs 1,299","say ""hi"",\nthere",x\n')
    got = IO.read_orders_csv(spark, path).first()
    assert (got.OrderID, got.DeliveryStatus, got.PriorReturns, got.PriorOrders) == ("ORD1", "Returned", 1, 2)
    assert got.Category == 'say "hi",\nthere' and got.OrderValue == "Rs 1,299"
    assert got.State is None and got.Items is None
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as f:
        f.write("OrderID,State\nORD1,Goa\n")
    with pytest.raises(IO.MissingColumnsError):
        IO.read_orders_csv(spark, bad)
    back = os.path.join(d, "back")
    IO.write_orders_csv(IO.read_orders_csv(spark, path), back)
    assert IO.read_orders_csv(spark, back).first() == got


def test_tables_of_one_name_do_not_touch_each_other(spark):
    from parcelwise.sources.store import materialize
    one = materialize(spark, spark.range(3), "same")
    two = materialize(spark, spark.range(5), "same")
    assert (one.count(), two.count()) == (3, 5)


def test_no_checkpoint_folder_on_a_cluster_is_an_error():
    import pytest
    from parcelwise.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
