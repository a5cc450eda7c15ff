"""Declared schemas; nothing in the package infers a schema from data."""

from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"

# Bank and account ids are text: leading zeros are significant.
# Fixed values.
RAW_TRANSFER = T.StructType(
    [
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("from_bank", T.StringType()),
        T.StructField("from_account", T.StringType()),
        T.StructField("to_bank", T.StringType()),
        T.StructField("to_account", T.StringType()),
        T.StructField("amount_received", T.DoubleType()),
        T.StructField("receiving_currency", T.StringType()),
        T.StructField("amount_paid", T.DoubleType()),
        T.StructField("payment_currency", T.StringType()),
        T.StructField("payment_format", T.StringType()),
        T.StructField("is_laundering", T.ByteType()),
    ]
)

# One wide struct for every detector; a field a detector does not fill is NULL.
EVIDENCE = T.StructType(
    [
        T.StructField("hub", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("degree", T.LongType()),
        T.StructField("tightness", T.DoubleType()),
        T.StructField("uniformity", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("amount_in", T.DoubleType()),
        T.StructField("amount_out", T.DoubleType()),
        T.StructField("hold_hours", T.DoubleType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("transactions", T.LongType()),
    ]
)

CANDIDATE = T.StructType(
    [
        T.StructField("accounts", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", EVIDENCE),
    ]
)
