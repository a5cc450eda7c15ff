"""Structural detectors over the enriched edge table, the account table and transfers.

Every detector returns ``accounts, kind, score, evidence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import account_set, evidence, hours_between, money_sum
from flowtrail.functions.skew import drop_heavy, shuffled
from flowtrail.operators.filters import volume_capped
from flowtrail.params import DetectionParams


def _candidate(rows: DataFrame, accounts, kind: str, score, proof) -> DataFrame:
    return rows.select(
        account_set(accounts).alias("accounts"), F.lit(kind).alias("kind"), score.alias("score"), proof.alias("evidence")
    )


def star_statistics(edges: DataFrame, outgoing: bool, params: DetectionParams) -> DataFrame:
    """Degree-banded stars with timing and amount statistics, one row per hub.

    The band is applied on the edge, so a hub's group holds at most ``star_max`` rows.
    The spread of the amounts is the exact two-pass value: within-edge deviations plus
    the deviation of each edge mean from the hub mean.
    """
    hub, leaf, degree, mean = (
        ("from_node", "to_node", "from_out_degree", "from_out_mean")
        if outgoing
        else ("to_node", "from_node", "to_in_degree", "to_in_mean")
    )
    banded = edges.where(F.col(degree).between(params.star_min, params.star_max))
    gap = F.col("mean_amount") - F.col(mean)
    stars = banded.groupBy(F.col(hub).alias("hub")).agg(
        F.count("*").alias("degree"),
        F.sum("count").alias("transactions"),
        money_sum("total_amount").alias("total_amount"),
        F.max(mean).alias("mean_amount"),
        F.sum(F.col("m2") + F.col("count") * gap * gap).alias("m2"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.collect_list(leaf).alias("leaves"),
    )
    spread = F.sqrt(F.col("m2") / (F.col("transactions") - 1))
    tight = F.greatest(
        F.lit(0.0), 1 - hours_between("first_seen", "last_seen") / F.lit(params.star_window_hours * 2)
    )
    # Zero mean with any spread counts as wholly irregular.
    uniform = F.when(spread == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.try_divide(spread, F.col("mean_amount"))), F.lit(0.0))
    )
    return (
        stars.where(F.col("transactions") > 1)
        .withColumn("std_amount", spread)
        .withColumn("tightness", tight)
        .withColumn("uniformity", uniform)
        .withColumn("score", F.col("tightness") * 0.5 + F.col("uniformity") * 0.5)
        .where(F.col("score") > 0)
    )


def _stars(edges: DataFrame, outgoing: bool, kind: str, params: DetectionParams) -> DataFrame:
    stars = star_statistics(edges, outgoing, params)
    return _candidate(
        stars,
        F.array_append("leaves", F.col("hub")),
        kind,
        F.col("score"),
        evidence(
            hub=F.col("hub"),
            degree=F.col("degree"),
            tightness=F.round("tightness", 3),
            uniformity=F.round("uniformity", 3),
            total_amount=F.col("total_amount"),
        ),
    )


def fan_out(edges: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    return _stars(edges, True, "fan_out", params)


def fan_in(edges: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    return _stars(edges, False, "fan_in", params)


def pass_through_pairs(search: DataFrame, accounts: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    """Receipts matched to later, near-equal payments of the same account.

    Only volume-capped accounts take part, so one account compares at most
    ``volume_cap`` receipts with as many payments; the time and amount bounds are part
    of the join condition. Rows of busy accounts leave before the shuffle.
    """
    cap = params.volume_cap
    eligible = volume_capped(accounts, cap).select(F.col("node").alias("_ok"))

    def side(node: str, weight: str) -> DataFrame:
        return drop_heavy(search, node, accounts, "node", weight, cap).join(
            shuffled(eligible), F.col(node) == F.col("_ok"), "left_semi"
        )

    ins = side("to_node", "in_rows").select(
        F.col("to_node").alias("node"),
        F.col("from_node").alias("payer"),
        F.col("amount_paid").alias("amount_in"),
        F.col("timestamp").alias("t_in"),
    )
    outs = side("from_node", "out_rows").select(
        F.col("from_node").alias("out_node"),
        F.col("to_node").alias("payee"),
        F.col("amount_paid").alias("amount_out"),
        F.col("timestamp").alias("t_out"),
    )
    ratio = F.try_divide("amount_out", "amount_in")
    lag = hours_between("t_in", "t_out")
    low, high = 1 - params.amount_tolerance, 1 + params.amount_tolerance
    return (
        ins.join(
            shuffled(outs),
            (F.col("node") == F.col("out_node"))
            & (F.col("t_out") >= F.col("t_in"))
            & (lag <= params.max_lag_hours)
            & ratio.between(low, high),
        )
        .drop("out_node")
        .withColumn("ratio", ratio)
        .withColumn("lag_hours", lag)
    )


def best_pairs(pairs: DataFrame) -> DataFrame:
    """The closest amount match of each account, with a total order on ties."""
    chosen = F.struct("payer", "payee", "amount_in", "amount_out", "ratio", "lag_hours", "t_in", "t_out")
    order = F.struct(
        F.abs(F.col("ratio") - 1).alias("gap"), F.col("t_in"), F.col("t_out"), F.col("payer"), F.col("payee"),
        F.col("amount_in"), F.col("amount_out"),
    )
    return pairs.groupBy("node").agg(F.min_by(chosen, order).alias("b")).select("node", "b.*")


def pass_through(search: DataFrame, accounts: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    best = best_pairs(pass_through_pairs(search, accounts, params))
    fit = 1 - F.abs(F.col("ratio") - 1) / F.lit(params.amount_tolerance)
    speed = 1 - F.col("lag_hours") / F.lit(params.max_lag_hours)
    return _candidate(
        best,
        F.array("payer", "node", "payee"),
        "pass_through",
        fit * 0.6 + speed * 0.4,
        evidence(
            node=F.col("node"),
            amount_in=F.col("amount_in"),
            amount_out=F.col("amount_out"),
            hold_hours=F.round("lag_hours", 1),
        ),
    )


def activity(accounts: DataFrame) -> DataFrame:
    """Transfers, amount and life span of each account over both of its roles."""
    return accounts.select(
        "node",
        (F.col("out_rows") + F.col("in_rows")).alias("transactions"),
        (F.col("out_total") + F.col("in_total")).alias("total_amount"),
        F.least("out_first", "in_first").alias("first_seen"),
        F.greatest("out_last", "in_last").alias("last_seen"),
    )


def velocity_burst(accounts: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    """Accounts whose whole activity falls into one short span. No shuffle."""
    span = hours_between("first_seen", "last_seen")
    busy = (
        activity(accounts)
        .where(F.col("transactions").between(params.star_min, params.volume_cap))
        .withColumn("span", span)
        .where((F.col("span") > 0) & (F.col("span") <= params.burst_window_hours))
    )
    return _candidate(
        busy,
        F.array("node"),
        "velocity_burst",
        1 - F.col("span") / F.lit(params.burst_window_hours),
        evidence(transactions=F.col("transactions"), total_amount=F.col("total_amount")),
    )
