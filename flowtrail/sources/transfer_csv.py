"""Raw transfer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtrail.functions.columns import node_id
from flowtrail.schema import RAW_TRANSFER, TIMESTAMP_FORMAT


def read_transfers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Eleven declared columns and both node ids; the header's own names are ignored.

    The raw header repeats a column name, so names come from the schema.
    """
    raw = (
        spark.read.schema(RAW_TRANSFER)
        .option("header", True)
        .option("enforceSchema", True)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return with_nodes(raw)


def with_nodes(raw: DataFrame) -> DataFrame:
    return raw.withColumn("from_node", node_id("from_bank", "from_account")).withColumn(
        "to_node", node_id("to_bank", "to_account")
    )


def write_transfers_csv(transfers: DataFrame, path: str) -> None:
    transfers.select(*RAW_TRANSFER.fieldNames()).write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", TIMESTAMP_FORMAT
    ).csv(path)
