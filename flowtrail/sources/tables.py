"""Persisted tables: the labelled cache, the ranked queue and the findings bundle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.operators.labels import account_labels, ring_summary

LABELLED, SUMMARY, ACCOUNT_LABELS, QUEUE = "transfers_labelled", "rings", "account_labels", "detected_rings"


#: Names the version that readers take.
MANIFEST = "_current"


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that was last completed, or none."""
    fs, _ = _file_system(spark, folder)
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    if not fs.exists(manifest):
        return None
    stream = fs.open(manifest)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{folder}/{name}"


def _publish(spark: SparkSession, folder: str, version: str) -> None:
    """Points readers at a version: the manifest is written aside and renamed over the old one, in one step."""
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    fs, _ = _file_system(spark, folder)
    aside = hadoop.Path(f"{folder}/.{version}.manifest")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    rename = getattr(hadoop, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(hadoop.Path(f"{folder}/{MANIFEST}")), options)


def write_snapshot(spark: SparkSession, folder: str, writers: dict[str, Callable[[str], None]], force: bool = False) -> bool:
    """Writes tables as one version that appears as a whole, or leaves a complete one alone unless forced.

    ``writers`` maps table names to functions that write to a path. What a writer that failed
    half-way left behind is no version: no manifest names it, and the next write starts anew.
    Readers of an older version are not disturbed; ``sweep`` removes what no manifest names.
    """
    if not force and current_version(spark, folder):
        return False
    version = f"v-{uuid.uuid4().hex[:12]}"
    for name, write in writers.items():
        write(f"{folder}/{version}/{name}")
    _publish(spark, folder, version)
    return True


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes all versions but the current one, unfinished ones too; for when no writer or older reader is at work."""
    fs, path = _file_system(spark, folder)
    now = (current_version(spark, folder) or "").rsplit("/", 1)[-1]
    gone = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("v-") and x.getPath().getName() != now]
    for old in gone:
        fs.delete(old, True)
    return sorted(x.getName() for x in gone)


def write_labelled_cache(labelled: DataFrame, patterns: DataFrame, folder: str, force: bool = False) -> bool:
    """Three tables of one version; left alone when there is a complete one, unless forced.

    Transfers are partitioned by rail, so the search slice reads only its own files.
    """
    return write_snapshot(
        labelled.sparkSession, folder,
        {
            LABELLED: lambda path: labelled.write.partitionBy("payment_format").parquet(path),
            SUMMARY: lambda path: ring_summary(patterns).write.parquet(path),
            ACCOUNT_LABELS: lambda path: account_labels(patterns).write.parquet(path),
        },
        force,
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the current version, or of the folder itself where it has none; Spark's own error names a missing path."""
    return spark.read.parquet(f"{current_version(spark, folder) or folder}/{name}")


def read_labelled_cache(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, LABELLED)


def write_queue(rings: DataFrame, folder: str) -> None:
    """The ranked queue in rank order, so a rank filter skips row groups."""
    rings.repartitionByRange("ring_id").sortWithinPartitions("ring_id").write.mode("overwrite").parquet(
        f"{folder}/{QUEUE}"
    )


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, QUEUE)


def find_ring(rings: DataFrame, ring_id: int) -> DataFrame:
    return rings.where(F.col("ring_id") == ring_id)


def write_bundle(sections: dict[str, DataFrame], folder: str) -> None:
    """One JSON-lines folder per section of the findings."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, section: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{section}")
