"""A conventional threshold-rule engine, for comparison with the queue.

The account-day and account-hour totals are not computed with windows over transfers: a
busy account would put its whole history into one task. Transfers are first rolled up to
account, day, hour and their own flags, which leaves at most a few hundred rows per
account and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.functions.columns import money_sum, ratio_or_zero
from flowtrail.functions.skew import attach
from flowtrail.params import RuleLimits

# Rule names in reporting order.
RULES = (
    "large_single_transaction",
    "high_daily_volume",
    "overnight_activity",
    "high_frequency",
    "large_cross_border",
)


def rule_descriptions(limits: RuleLimits = RuleLimits()) -> dict[str, str]:
    # The wording of the reports.
    texts = (
        f"Single transaction over {limits.single_amount:,}",
        f"Account moves over {limits.daily_volume:,} in a day",
        f"Transaction between {limits.night_first_hour}am and {limits.night_last_hour + 1}am",
        f"Over {limits.hourly_count} transactions from one account in an hour",
        f"Cross-border transfer over {limits.cross_border_amount:,}",
    )
    return dict(zip(RULES, texts))


def _row_flags(limits: RuleLimits) -> dict[str, Column]:
    amount = F.col("amount_paid")
    abroad = F.col("payment_currency") != F.col("receiving_currency")
    return {
        "large_single_transaction": F.coalesce(amount > limits.single_amount, F.lit(False)),
        "overnight_activity": F.hour("timestamp").between(limits.night_first_hour, limits.night_last_hour),
        "large_cross_border": F.coalesce(abroad & (amount > limits.cross_border_amount), F.lit(False)),
    }


def _slot_totals(rollup: DataFrame, limits: RuleLimits) -> DataFrame:
    day = Window.partitionBy("from_node", "day")
    hour = Window.partitionBy("from_node", "day", "hour")
    return rollup.withColumn(
        "high_daily_volume", F.coalesce(F.round(F.sum("amount").over(day), 6) > F.lit(limits.daily_volume), F.lit(False))
    ).withColumn("high_frequency", F.sum("rows").over(hour) > limits.hourly_count)


def rule_flags(transfers: DataFrame, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """Every transfer with five boolean columns."""
    slot = F.struct(F.col("from_node").alias("n"), F.to_date("timestamp").alias("d"), F.hour("timestamp").alias("h"))
    rollup = transfers.groupBy(
        "from_node", F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour")
    ).agg(F.count("*").alias("rows"), money_sum("amount_paid").alias("amount"))
    flagged_slots = _slot_totals(rollup, limits).where(F.col("high_daily_volume") | F.col("high_frequency")).select(
        F.struct(F.col("from_node").alias("n"), F.col("day").alias("d"), F.col("hour").alias("h")).alias("slot"),
        "rows",
        "high_daily_volume",
        "high_frequency",
    )
    marked = attach(
        transfers.withColumns(_row_flags(limits)).withColumn("_slot", slot),
        flagged_slots,
        ("_slot", "slot"),
        {"high_daily_volume": "high_daily_volume", "high_frequency": "high_frequency"},
    )
    return marked.drop("_slot").fillna(False, ["high_daily_volume", "high_frequency"])


def rule_profile(transfers: DataFrame, limits: RuleLimits = RuleLimits()) -> DataFrame:
    """Counts of transfers per combination of rule flags and label."""
    flags = _row_flags(limits)
    rollup = transfers.groupBy(
        "from_node",
        F.to_date("timestamp").alias("day"),
        F.hour("timestamp").alias("hour"),
        *[c.alias(n) for n, c in flags.items()],
        F.coalesce(F.col("is_laundering") == 1, F.lit(False)).alias("laundering"),
    ).agg(F.count("*").alias("rows"), money_sum("amount_paid").alias("amount"))
    return _slot_totals(rollup, limits).groupBy(*RULES, "laundering").agg(F.sum("rows").alias("rows"))


def _any_rule() -> Column:
    hit = F.col(RULES[0])
    for rule in RULES[1:]:
        hit = hit | F.col(rule)
    return hit


def per_rule(profile: DataFrame, limits: RuleLimits = RuleLimits()) -> DataFrame:
    texts = rule_descriptions(limits)
    fired = profile.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("rule"),
                        F.lit(texts[r]).alias("description"),
                        F.when(F.col(r), F.col("rows")).otherwise(0).alias("flags"),
                        F.when(F.col(r) & F.col("laundering"), F.col("rows")).otherwise(0).alias("caught"),
                    )
                    for r in RULES
                ]
            )
        ).alias("x")
    ).select("x.*")
    return fired.groupBy("rule", "description").agg(
        F.sum("flags").alias("flags"), F.sum("caught").alias("laundering_caught")
    )


def rule_evaluation(profile: DataFrame) -> DataFrame:
    """Totals of the rule engine over the profile, one row."""

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("rows"))), F.lit(0))

    hit, bad = _any_rule(), F.col("laundering")
    totals = profile.agg(
        rows(hit).alias("total_flags"),
        rows(bad).alias("total_laundering_transactions"),
        rows(hit & bad).alias("laundering_caught"),
        rows(F.lit(True)).alias("transactions_scanned"),
    )
    caught = F.col("laundering_caught")
    return totals.select(
        "total_flags",
        "total_laundering_transactions",
        "laundering_caught",
        (F.col("total_laundering_transactions") - caught).alias("laundering_missed"),
        F.round(ratio_or_zero(caught, F.col("total_laundering_transactions")), 4).alias("recall"),
        F.round(ratio_or_zero(caught, F.col("total_flags")), 6).alias("precision"),
        "transactions_scanned",
    )
