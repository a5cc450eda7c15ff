"""Queue and threshold rules measured on the same transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside, ratio_or_zero
from flowtrail.functions.skew import attach
from flowtrail.params import COMPARISON_DEPTHS
from flowtrail.session import stage


def measure(flagged: Column, caught: Column, truth: Column, total: Column) -> list[Column]:
    """Workload, recall and precision of one set of flagged transfers."""
    return [
        flagged.alias("flagged"),
        F.round(ratio_or_zero(flagged, total), 5).alias("flag_rate"),
        caught.alias("caught"),
        (truth - caught).alias("missed"),
        F.round(ratio_or_zero(caught, truth), 4).alias("recall"),
        F.round(ratio_or_zero(caught, flagged), 6).alias("precision"),
        F.round(F.try_divide(flagged, caught), 0).cast("bigint").alias("alerts_per_case"),
    ]


def pair_labels(transfers: DataFrame) -> DataFrame:
    """Transfers and laundering transfers per account pair, self-payments included."""
    return transfers.groupBy("from_node", "to_node").agg(
        F.count("*").alias("rows"), F.count_if(F.col("is_laundering") == 1).alias("bad")
    )


def best_rank(rings: DataFrame) -> DataFrame:
    """The best rank among the rings each account belongs to."""
    return rings.select("ring_id", F.explode("accounts").alias("account")).groupBy("account").agg(
        F.min("ring_id").alias("best_rank")
    )


def pair_depth(labels: DataFrame, rings: DataFrame) -> DataFrame:
    """The queue depth from which both accounts of a pair lie inside top rings.

    The two accounts may come from different rings. NULL when either is in no ring.
    """
    ranks = stage(best_rank(rings), "best-rank")
    one = attach(labels, ranks, ("from_node", "account"), {"best_rank": "from_rank"})
    both = attach(one, ranks, ("to_node", "account"), {"best_rank": "to_rank"}, keys_from=labels)
    known = F.col("from_rank").isNotNull() & F.col("to_rank").isNotNull()
    return both.select(
        "from_node", "to_node", "rows", "bad", F.when(known, F.greatest("from_rank", "to_rank")).alias("depth")
    )


def depth_histogram(depths: DataFrame) -> DataFrame:
    """Transfers and laundering transfers per queue depth; at most a row per ring."""
    return depths.groupBy("depth").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


def queue_counts(depths: DataFrame, at: tuple[int, ...] = COMPARISON_DEPTHS) -> DataFrame:
    """Flagged and caught transfers at every depth, from one pass."""

    def total(cond: Column, col: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(col))), F.lit(0))

    cuts = [(f"top_{d}", F.lit(d), F.col("depth") <= d) for d in at]
    cuts += [("full_queue", F.lit(None), F.col("depth").isNotNull()), ("flag_everything", F.lit(None), F.lit(True))]
    one = depths.agg(
        F.sum("rows").alias("total"),
        F.sum("bad").alias("truth"),
        *[total(c, "rows").alias(f"{n}_flagged") for n, _, c in cuts],
        *[total(c, "bad").alias(f"{n}_caught") for n, _, c in cuts],
    )
    return one.select(
        "total",
        "truth",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("engine"),
                        d.cast("bigint").alias("depth"),
                        F.col(f"{n}_flagged").alias("flagged"),
                        F.col(f"{n}_caught").alias("caught"),
                    )
                    for n, d, _ in cuts
                ]
            )
        ).alias("c"),
    ).select("total", "truth", "c.*")


def compare(depths: DataFrame, rule_totals: DataFrame, rings: DataFrame, at=COMPARISON_DEPTHS) -> DataFrame:
    """One row per engine setting; depths beyond the queue are left out."""
    size = rings.agg(F.count("*").alias("rings_in_queue"))
    queue = queue_counts(depths, at).where(F.col("depth").isNull() | (F.col("depth") <= size.scalar()))
    rules = rule_totals.select(
        F.col("transactions_scanned").alias("total"),
        F.col("total_laundering_transactions").alias("truth"),
        F.lit("rule_engine").alias("engine"),
        F.lit(None).cast("bigint").alias("depth"),
        F.col("total_flags").alias("flagged"),
        F.col("laundering_caught").alias("caught"),
    )
    rows = queue.unionByName(rules)
    return rows.select(
        "engine", "depth", *measure(F.col("flagged"), F.col("caught"), F.col("truth"), F.col("total"))
    )


def comparison_summary(comparison: DataFrame, rule_totals: DataFrame, rings: DataFrame) -> DataFrame:
    """Base rate, queue size and lift of the shallowest depth over blind guessing."""
    size = rings.agg(F.count("*").alias("rings_in_queue"))
    head = comparison.where(F.col("depth").isNotNull()).agg(F.min_by("precision", "depth").alias("head_precision"))
    base = ratio_or_zero(F.col("total_laundering_transactions"), F.col("transactions_scanned"))
    return beside(rule_totals, size, head).select(
        "transactions_scanned",
        F.col("total_laundering_transactions").alias("laundering_total"),
        F.round(base, 6).alias("base_rate"),
        "rings_in_queue",
        F.round(F.try_divide(F.col("head_precision"), base), 0).cast("bigint").alias("lift_at_top"),
    )


def headline(rule_totals: DataFrame, scan_totals: DataFrame) -> DataFrame:
    """Rule flags beside queue size, rings shown and accounts traced."""
    return beside(rule_totals, scan_totals).select(
        F.col("total_flags").alias("rule_engine_flags"),
        F.col("laundering_caught").alias("rule_engine_caught"),
        F.col("laundering_missed").alias("rule_engine_missed"),
        F.col("rings_in_queue").alias("graph_engine_rings"),
        F.col("rings_detected").alias("graph_engine_top_rings"),
        F.col("total_accounts_flagged").alias("graph_engine_accounts_traced"),
    )


def deltas(comparison: DataFrame) -> DataFrame:
    """What the full queue changes against the threshold rules."""
    metrics = ("flagged", "caught", "missed", "recall", "precision", "alerts_per_case")
    wide = comparison.where(F.col("engine").isin("full_queue", "rule_engine")).agg(
        *[F.max(F.when(F.col("engine") == e, F.col(m))).alias(f"{t}_{m}")
          for e, t in (("full_queue", "q"), ("rule_engine", "r")) for m in metrics]
    )
    return wide.select(
        F.round(F.try_divide("r_flagged", "q_flagged"), 0).cast("bigint").alias("alert_reduction"),
        (F.col("q_caught") - F.col("r_caught")).alias("extra_caught"),
        (F.col("r_missed") - F.col("q_missed")).alias("fewer_missed"),
        F.round((F.col("q_recall") - F.col("r_recall")) * 100, 1).alias("recall_points"),
        F.round(F.try_divide("q_precision", "r_precision"), 1).alias("precision_ratio"),
        F.round(F.try_divide("r_alerts_per_case", "q_alerts_per_case"), 0).cast("bigint").alias("workload_ratio"),
    )
