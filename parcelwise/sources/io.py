"""Order files: CSV export, and import by header name.

The CSV reader never infers types (a full extra pass over the data, and a per-file guess
that can differ between files); messy columns are read as text and parsed by the
cleaning operators. Whitespace is preserved on both write and read, because padding is
part of the mess the cleaner has to see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.functions.exprs import null_tokens_to_null

RAW_SCHEMA = T.StructType([
    T.StructField("OrderID", T.StringType()),
    T.StructField("CustomerID", T.StringType()),
    T.StructField("OrderDay", T.IntegerType()),
    T.StructField("CityTier", T.StringType()),
    T.StructField("State", T.StringType()),
    T.StructField("Category", T.StringType()),
    T.StructField("OrderValue", T.StringType()),
    T.StructField("DiscountPct", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("Device", T.StringType()),
    T.StructField("AddressQuality", T.StringType()),
    T.StructField("OrderHour", T.IntegerType()),
    T.StructField("Items", T.IntegerType()),
    T.StructField("PriorOrders", T.IntegerType()),
    T.StructField("PriorReturns", T.IntegerType()),
    T.StructField("DeliveryStatus", T.StringType()),
])

#: An order file must have these columns; all others may be absent and are then NULL.
REQUIRED = ["OrderID", "OrderValue", "PaymentMethod", "PriorOrders", "PriorReturns", "DeliveryStatus"]

_CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "emptyValue": "\"\"",
    "quote": "\"",
    "escape": "\"",  # a quote inside a quoted cell is doubled
}


class MissingColumnsError(ValueError):
    pass


def write_orders_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header row and no index column; NULL is written as an empty field."""
    w = df.write.mode(mode)
    for k, v in _CSV_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)


def _read_text(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every column as text under the names in the file's header."""
    r = spark.read.option("mode", "PERMISSIVE").option("enforceSchema", "false").option("multiLine", multi_line)
    for k, v in _CSV_OPTIONS.items():
        if k != "emptyValue":
            r = r.option(k, v)
    return r.csv(path)


def read_orders_csv(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_SCHEMA,
                    null_tokens: bool = True, multi_line: bool = True,
                    required: list[str] = REQUIRED) -> DataFrame:
    """Read one file, a folder, a glob or a list of them into the order schema.

    Columns are found by their header names (case and outer blanks ignored), in any order;
    an absent optional column is NULL, an absent required one an error, others are ignored.
    Each entry of a list may have its own layout; the files under one entry share one (a file
    whose header differs from its neighbours' fails the read instead of being shifted).

    Quoted cells may hold commas, doubled quotes and line breaks; ``multi_line=False`` gives
    up line breaks inside cells for files that are split over tasks. CSV has a single
    ``nullValue``; exports also write 'NA', 'NaN', 'null', 'None' ... for missing text. With
    ``null_tokens`` those become NULL in every string column."""
    out = None
    for one in ([path] if isinstance(path, str) else path):
        text = _read_text(spark, one, multi_line)
        names = [f"c{i}" for i in range(len(text.columns))]
        place = {c.strip().lstrip("\ufeff").lower(): n for c, n in reversed(list(zip(text.columns, names, strict=True)))}
        missing = [c for c in required if c in schema.names and c.lower() not in place]
        if missing:
            raise MissingColumnsError(f"{one} lacks required columns: {missing}")
        columns = []
        for f in schema.fields:
            cell = F.col(place[f.name.lower()]) if f.name.lower() in place else F.lit(None).cast("string")
            if isinstance(f.dataType, T.StringType):
                cell = null_tokens_to_null(cell) if null_tokens else cell
            else:
                cell = F.trim(cell).try_cast(f.dataType)
            columns.append(cell.alias(f.name))
        rows = text.toDF(*names).select(*columns)
        out = rows if out is None else out.union(rows)
    return out


def read_text_csv(spark: SparkSession, path: str | list[str],
                  columns: list[str]) -> DataFrame:
    """Every column as text, exactly as written in the file."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_orders_csv(spark, path, schema=schema, null_tokens=False)
