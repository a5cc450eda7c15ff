"""The labelled-ring log: text blocks of BEGIN line, transfer rows, END line.

Nothing here depends on one task reading the whole file. Counts run within a file split
and are shifted by the totals of the splits before it; a line finds the marker above it,
and a marker the one before it, by joining on that running count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtrail.functions.skew import attach
from flowtrail.schema import RAW_TRANSFER, TIMESTAMP_FORMAT
from flowtrail.session import stage
from flowtrail.sources.transfer_csv import with_nodes

# The marker line formats.
BEGIN_LINE = r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)(?::\s*(.*))?$"
END_LINE = r"^END LAUNDERING ATTEMPT - ([A-Z-]+)$"

BLANKS = " \t\r\n\x0b\x0c"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order with their number and the markers and BEGINs counted so far."""
    text = F.btrim(F.col("value"), F.lit(BLANKS))
    lines = stage(
        spark.read.text(path)
        .select(
            text.alias("text"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
        )
        .withColumn("kind", F.when(F.col("text").rlike(BEGIN_LINE), "begin").when(F.col("text").rlike(END_LINE), "end")),
        "ring-log",
    )
    within = Window.partitionBy("file", "split").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    is_begin = (F.coalesce(F.col("kind"), F.lit("")) == "begin").cast("int")
    is_marker = F.col("kind").isNotNull().cast("int")
    totals = lines.groupBy("file", "split").agg(
        F.count("*").alias("n"), F.sum(is_marker).alias("m"), F.sum(is_begin).alias("b")
    )
    # One row per file split.
    earlier = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        "file", "split", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in ("n", "m", "b")]
    )
    return lines.join(F.broadcast(shift), ["file", "split"]).select(
        "text",
        "kind",
        (F.col("_n") + F.count("*").over(within)).alias("line"),
        (F.col("_m") + F.sum(is_marker).over(within)).alias("marker"),
        (F.col("_b") + F.sum(is_begin).over(within)).alias("ordinal"),
    )


def _markers(lines: DataFrame) -> DataFrame:
    begin = F.col("kind") == "begin"
    return lines.where(F.col("kind").isNotNull()).select(
        "marker",
        "kind",
        "line",
        "ordinal",
        F.when(begin, F.regexp_extract("text", BEGIN_LINE, 1)).otherwise(F.regexp_extract("text", END_LINE, 1)).alias("type"),
        F.when(begin, F.btrim(F.regexp_extract("text", BEGIN_LINE, 2), F.lit(BLANKS))).alias("detail"),
    )


def _body(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("kind").isNull() & (F.col("text") != "")).select("text", "line", "marker")
    return attach(
        rows,
        _markers(lines),
        ("marker", "marker"),
        {"kind": "above", "ordinal": "ring_id", "type": "pattern_type", "detail": "pattern_detail"},
    )


def violations(lines: DataFrame) -> DataFrame:
    """Every structural fault as ``line, rule``; an empty table means a sound log."""
    marks = _markers(lines)
    before = marks.select(
        (F.col("marker") + 1).alias("marker"), F.col("kind").alias("prev_kind"), F.col("type").alias("prev_type")
    )
    open_before = F.coalesce(F.col("prev_kind") == "begin", F.lit(False))
    pairs = marks.join(before, "marker", "left")
    fault = (
        F.when((F.col("kind") == "begin") & open_before, "nested_begin")
        .when((F.col("kind") == "end") & ~open_before, "end_without_begin")
        .when((F.col("kind") == "end") & (F.col("type") != F.col("prev_type")), "end_type_mismatch")
    )
    marker_faults = pairs.select("line", fault.alias("rule")).where(F.col("rule").isNotNull())
    stray = _body(lines).where(F.coalesce(F.col("above") == "end", F.lit(True))).select(
        "line", F.lit("row_outside_block").alias("rule")
    )
    last = marks.agg(F.max_by(F.struct("kind", "line"), "marker").alias("m")).where(F.col("m.kind") == "begin")
    unclosed = last.select(F.col("m.line").alias("line"), F.lit("unclosed_block").alias("rule"))
    return marker_faults.unionByName(stray).unionByName(unclosed)


def ring_rows(lines: DataFrame) -> DataFrame:
    """One row per labelled transfer; ``ring_id`` is the ordinal of the block in the log."""
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_TRANSFER.fields)
    options = {"timestampNTZFormat": TIMESTAMP_FORMAT, "mode": "FAILFAST"}
    parsed = _body(lines).select(
        "line", "ring_id", "pattern_type", F.coalesce("pattern_detail", F.lit("")).alias("pattern_detail"),
        F.from_csv("text", ddl, options).alias("t"),
    )
    return with_nodes(parsed.select("line", "ring_id", "pattern_type", "pattern_detail", "t.*"))


def parse_ring_log(spark: SparkSession, path: str) -> DataFrame:
    """Validated labelled rows; raises when the log is structurally unsound."""
    lines = numbered_lines(spark, path)
    bad = violations(lines).orderBy("line").head(5)
    if bad:
        raise ValueError("ring log: " + "; ".join(f"line {r['line']}: {r['rule']}" for r in bad))
    return ring_rows(lines)
