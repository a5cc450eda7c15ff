"""Attach ring labels to transfers and describe the labelled rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import amount_key, beside, hours_between, money_sum

JOIN_KEYS = ("timestamp", "from_node", "to_node", "payment_format", "amount_key")


def label_keys(patterns: DataFrame, order: str = "line") -> DataFrame:
    """One row per transfer key, keeping the label that comes first in the log."""
    first = F.min_by(F.struct("ring_id", "pattern_type"), F.struct(F.col(order), F.col("ring_id")))
    return (
        patterns.withColumn("amount_key", amount_key("amount_paid"))
        .groupBy(*JOIN_KEYS)
        .agg(first.alias("label"))
        .select(*JOIN_KEYS, "label.ring_id", "label.pattern_type")
    )


def attach_labels(transfers: DataFrame, patterns: DataFrame, order: str = "line") -> DataFrame:
    """Transfers with nullable ``ring_id`` and ``pattern_type``; never adds or loses rows.

    The key table has one row per key by construction, so the join is many-to-one.
    """
    bare = transfers.drop("ring_id", "pattern_type").withColumn("amount_key", amount_key("amount_paid"))
    return bare.join(label_keys(patterns, order), list(JOIN_KEYS), "left").drop("amount_key")


def reconciliation(labelled: DataFrame, patterns: DataFrame, order: str = "line") -> DataFrame:
    """How cleanly the log matched the transfers, as one row of nine counters."""
    has_ring, bad = F.col("ring_id").isNotNull(), F.coalesce(F.col("is_laundering") == 1, F.lit(False))
    rows = labelled.agg(
        F.count("*").alias("transactions"),
        F.count_if(has_ring).alias("rows_assigned_to_a_ring"),
        F.count_distinct("ring_id").alias("rings"),
        F.count_if(bad).alias("is_laundering_rows"),
        F.count_if(bad & ~has_ring).alias("laundering_without_ring"),
        F.count_if(has_ring & ~bad).alias("ring_rows_not_flagged"),
    )
    keys = label_keys(patterns, order)
    matched = labelled.where(has_ring).withColumn("amount_key", amount_key("amount_paid")).select(*JOIN_KEYS)
    key_counts = keys.agg(F.count("*").alias("pattern_keys"))
    unmatched = keys.join(matched, list(JOIN_KEYS), "left_anti").agg(F.count("*").alias("unmatched_pattern_keys"))
    log = patterns.agg(F.count("*").alias("pattern_rows"))
    return beside(rows, log, key_counts, unmatched)


def gate(report: DataFrame) -> DataFrame:
    """A reconciliation with ``passed``: every key of the log matched a transfer."""
    return report.withColumn("passed", F.col("unmatched_pattern_keys") == 0)


def require_matched(report: DataFrame) -> DataFrame:
    """The reconciliation itself; refuses a log some of whose keys match no transfer."""
    row = report.select("unmatched_pattern_keys", "pattern_keys").head()
    if row[0]:
        raise ValueError(f"{row[0]} of {row[1]} keys of the ring log match no transfer")
    return report


def ring_members(patterns: DataFrame) -> DataFrame:
    """Distinct ``ring_id, pattern_type, node`` of labelled transfers."""
    return patterns.select(
        "ring_id", "pattern_type", F.explode(F.array("from_node", "to_node")).alias("node")
    ).distinct()


def ring_summary(patterns: DataFrame, order: str = "line") -> DataFrame:
    stats = patterns.groupBy("ring_id").agg(
        F.min_by("pattern_type", order).alias("pattern_type"),
        F.min_by("pattern_detail", order).alias("pattern_detail"),
        F.count("*").alias("transactions"),
        money_sum("amount_paid").alias("total_paid"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )
    sizes = ring_members(patterns).groupBy("ring_id").agg(F.count_distinct("node").alias("accounts"))
    return stats.withColumn("duration_hours", hours_between("first_seen", "last_seen")).join(sizes, "ring_id")


def account_labels(patterns: DataFrame) -> DataFrame:
    return (
        ring_members(patterns)
        .groupBy("node")
        .agg(
            F.count_distinct("ring_id").alias("ring_count"),
            F.sort_array(F.collect_set("ring_id")).alias("ring_ids"),
            F.sort_array(F.collect_set("pattern_type")).alias("pattern_types"),
        )
    )
