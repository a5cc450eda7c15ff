"""Case views, computed for all selected rings in one job.

``internal`` is the table of transfers with both ends inside a ring, one row per ring and
transfer, taken from the slice detection searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside, hours_between, money_sum
from flowtrail.functions.skew import shuffled
from flowtrail.operators.scoring import memberships
from flowtrail.params import CARD_TRANSFERS, CASE_TRANSFERS

TRANSFER_ORDER = ("timestamp", "from_node", "to_node", "amount_paid", "payment_currency")


def internal_transfers(selected: DataFrame, search: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """Transfers with both endpoints in a selected ring.

    Members meet the edges of each account's *owned* side - an edge is owned by its end
    with the smaller degree - so a hub's edges are never multiplied by the rings it is in,
    and the surviving pairs are joined to the transfers. For ``few`` rings, of which the queue's
    size guard bounds the members and so the pairs, members and pairs are broadcast and neither edges nor
    transfers are shuffled; otherwise nothing is broadcast, as members are far larger than
    the files of the rings they come from.
    """
    members = memberships(selected)
    side = F.broadcast if few else shuffled
    moves = search.select(*TRANSFER_ORDER)
    lower = F.struct("from_degree", "from_node") < F.struct("to_degree", "to_node")
    # Both ends once and a flag, so that no account is shuffled twice.
    owned = edges.select(
        F.when(lower, F.col("from_node")).otherwise(F.col("to_node")).alias("account"),
        F.when(lower, F.col("to_node")).otherwise(F.col("from_node")).alias("other"),
        lower.alias("leaving"),
    )
    from_node = F.when(F.col("leaving"), F.col("account")).otherwise(F.col("other")).alias("from_node")
    to_node = F.when(F.col("leaving"), F.col("other")).otherwise(F.col("account")).alias("to_node")
    partners = members.select("ring_id", F.col("account").alias("other"))
    pairs = (
        owned.join(side(members), "account").join(side(partners), ["ring_id", "other"]).select("ring_id", from_node, to_node)
    )
    return moves.join(side(pairs), ["from_node", "to_node"]).select("ring_id", *TRANSFER_ORDER)


def amount_by_currency(internal: DataFrame) -> DataFrame:
    """Amounts are never added across currencies."""
    return internal.groupBy("ring_id", F.col("payment_currency").alias("currency")).agg(
        F.round(money_sum("amount_paid"), 2).alias("amount")
    )


def first_transfers(internal: DataFrame, n: int) -> DataFrame:
    """The earliest ``n`` transfers of each ring; Spark prunes to n per ring before the shuffle."""
    place = F.row_number().over(Window.partitionBy("ring_id").orderBy(*TRANSFER_ORDER))
    return internal.withColumn("place", place).where(F.col("place") <= n)


def ring_flow(internal: DataFrame) -> DataFrame:
    """Totals of each ring's internal movement."""
    return internal.groupBy("ring_id").agg(
        F.count("*").alias("transactions"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def account_flow(internal: DataFrame) -> DataFrame:
    """What each ring account received and sent inside the ring."""
    sends = F.struct(F.col("from_node").alias("account"), F.lit(True).alias("out"))
    gets = F.struct(F.col("to_node").alias("account"), F.lit(False).alias("out"))
    moves = internal.select("ring_id", "timestamp", "amount_paid", F.explode(F.array(sends, gets)).alias("m")).select(
        "ring_id", "timestamp", "amount_paid", "m.*"
    )
    out = F.col("out")
    return moves.groupBy("ring_id", "account").agg(
        F.count_if(~out).alias("gets"),
        F.count_if(out).alias("sends"),
        money_sum(F.when(~out, F.col("amount_paid"))).alias("received"),
        money_sum(F.when(out, F.col("amount_paid"))).alias("sent"),
        F.min(F.when(~out, F.col("timestamp"))).alias("first_received"),
        F.min(F.when(out, F.col("timestamp"))).alias("first_sent"),
    )


def hold_times(internal: DataFrame, flow: DataFrame) -> DataFrame:
    """Hours from an account's first receipt to its first payment at or after it."""
    receipts = flow.where(F.col("first_received").isNotNull() & F.col("first_sent").isNotNull()).select(
        "ring_id", F.col("account").alias("from_node"), "first_received"
    )
    return (
        internal.join(receipts, ["ring_id", "from_node"])
        .where(F.col("timestamp") >= F.col("first_received"))
        .groupBy("ring_id", F.col("from_node").alias("account"))
        .agg(F.min("timestamp").alias("next_sent"), F.min("first_received").alias("first_received"))
        .select("ring_id", "account", F.round(hours_between("first_received", "next_sent"), 1).alias("hold_hours"))
    )


def positions(selected: DataFrame, internal: DataFrame) -> DataFrame:
    """Every account of every selected ring with its place in the flow."""
    gets, sends = F.coalesce("gets", F.lit(0)), F.coalesce("sends", F.lit(0))
    # The names of positions here and of roles and actions below.
    position = (
        F.when((sends > 0) & (gets == 0), "source")
        .when((gets > 0) & (sends == 0), "cash_out")
        .when((gets > 0) & (sends > 0), "intermediary")
        .otherwise("peripheral")
    )
    return memberships(selected).join(account_flow(internal), ["ring_id", "account"], "left").withColumn(
        "position", position
    )


def classify_roles(selected: DataFrame, internal: DataFrame, cross_rings: DataFrame) -> DataFrame:
    """Likely controllers and recruited mules of every ring that moved money.

    Confidence is counted in tenths (4 for an end of the flow, 3 for a second ring, 3 for
    moving first), so the half-way threshold is exact. Heuristic triage, not a verdict.
    """
    placed = positions(selected, internal)
    started = ring_flow(internal).select("ring_id", F.col("first_seen").alias("started"))
    seen = placed.join(cross_rings, "account", "left").join(started, "ring_id")
    held = hold_times(internal, placed)
    tenths = (
        F.when(F.col("position").isin("source", "cash_out"), 4).otherwise(0)
        + F.when(F.col("rings_appeared") > 1, 3).otherwise(0)
        + F.when(F.col("first_sent") == F.col("started"), 3).otherwise(0)
    )
    controller = F.col("tenths") >= 5
    return (
        seen.withColumn("rings_appeared", F.coalesce("rings_appeared", F.lit(1)))
        .withColumn("tenths", tenths)
        .join(held, ["ring_id", "account"], "left")
        .select(
            "ring_id",
            "account",
            "position",
            "rings_appeared",
            "hold_hours",
            F.round(F.coalesce("received", F.lit(0.0)), 2).alias("received"),
            F.round(F.coalesce("sent", F.lit(0.0)), 2).alias("sent"),
            (F.col("tenths") / 10).alias("confidence"),
            F.when(controller, F.concat("position", F.lit("_controller")))
            .otherwise("recruited_mule")
            .alias("role"),
            F.when(controller, "freeze_and_investigate").otherwise("contact_and_warn").alias("action"),
            controller.alias("is_controller"),
        )
    )


def controllers(roles: DataFrame) -> DataFrame:
    """Controllers of each ring, most confident first; at most one ring's accounts per window."""
    place = F.row_number().over(Window.partitionBy("ring_id").orderBy(F.col("confidence").desc(), "account"))
    return roles.where("is_controller").withColumn("place", place)


def _currency_list(internal: DataFrame) -> DataFrame:
    return amount_by_currency(internal).groupBy("ring_id").agg(
        F.sort_array(F.collect_list(F.struct("currency", "amount"))).alias("amount_by_currency")
    )


def _ends(selected: DataFrame, internal: DataFrame) -> DataFrame:
    at = positions(selected, internal)

    def accounts(kind: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("position") == kind, F.col("account"))))

    return at.groupBy("ring_id").agg(
        accounts("source").alias("source_accounts"), accounts("cash_out").alias("cashout_accounts")
    )


def _transfer_list(internal: DataFrame, n: int, *fields: Column) -> DataFrame:
    rows = first_transfers(internal, n)
    return (
        rows.groupBy("ring_id")
        .agg(F.sort_array(F.collect_list(F.struct("place", *fields))).alias("t"))
        .select("ring_id", F.transform("t", lambda x: x.dropFields("place")).alias("transactions"))
    )


def scan_rings(selected: DataFrame, internal: DataFrame) -> DataFrame:
    """One row per selected ring; rings without internal transfers stay with zero."""
    flow = ring_flow(internal).select("ring_id", F.col("transactions").alias("n"))
    return (
        selected.join(flow, "ring_id", "left")
        .join(_currency_list(internal), "ring_id", "left")
        .select(
            "ring_id",
            F.col("account_count").alias("accounts"),
            F.coalesce("n", F.lit(0)).alias("transactions"),
            "amount_by_currency",
            "signals",
            F.round("score", 4).alias("score"),
        )
    )


def traced_totals(internal: DataFrame) -> DataFrame:
    """Traced money per currency over the selected rings.

    A transfer inside several rings counts once per ring.
    """
    return amount_by_currency(internal).groupBy("currency").agg(F.round(money_sum("amount"), 2).alias("amount"))


def scan_totals(selected: DataFrame, rings: DataFrame) -> DataFrame:
    queue = rings.agg(F.count("*").alias("rings_in_queue"))
    shown = selected.agg(F.count("*").alias("rings_detected"))
    flagged = memberships(selected).agg(F.count_distinct("account").alias("total_accounts_flagged"))
    return beside(shown, queue, flagged)


def dominant_currency(totals: DataFrame) -> DataFrame:
    best = F.min_by(F.struct("currency", "amount"), F.struct((-F.col("amount")).alias("a"), F.col("currency")))
    return totals.agg(best.alias("b")).select("b.currency", F.round("b.amount", 0).alias("amount"))


def investigate(selected: DataFrame, internal: DataFrame, requested: DataFrame | None = None, n: int = CASE_TRANSFERS) -> DataFrame:
    """Flow, timing and first transfers of every ring, with a status instead of an error.

    ``requested`` (``ring_id`` rows) may name rings that do not exist.
    """
    stats = ring_flow(internal)
    transfers = _transfer_list(
        internal,
        n,
        F.col("from_node").alias("from"),
        F.col("to_node").alias("to"),
        F.round("amount_paid", 2).alias("amount"),
        F.col("payment_currency").alias("currency"),
        F.col("timestamp"),
    )
    known = selected.select("ring_id", "accounts", "account_count", "signals")
    base = requested.select("ring_id").join(known, "ring_id", "left") if requested is not None else known
    joined = (
        base.join(stats, "ring_id", "left")
        .join(_ends(selected, internal), "ring_id", "left")
        .join(_currency_list(internal), "ring_id", "left")
        .join(transfers, "ring_id", "left")
    )
    moved = F.col("first_seen").isNotNull()
    status = (
        F.when(F.col("accounts").isNull(), "not_found").when(~moved, "no_internal_transactions").otherwise("ok")
    )
    count = stats["transactions"]
    return joined.select(
        "ring_id",
        status.alias("status"),
        "accounts",
        "account_count",
        "source_accounts",
        "cashout_accounts",
        "amount_by_currency",
        count.alias("transaction_count"),
        F.round(hours_between("first_seen", "last_seen"), 1).alias("duration_hours"),
        "first_seen",
        "last_seen",
        "signals",
        F.transform("amount_by_currency", lambda x: x["currency"]).alias("currencies"),
        transfers["transactions"].alias("transactions"),
        F.when(count > n, count - n).when(count.isNotNull(), F.lit(0)).alias("transactions_truncated"),
    )


def case_files(investigation: DataFrame, roles: DataFrame) -> DataFrame:
    """Investigation and classified accounts of each ring in one nested record."""
    entry = F.struct(
        (-F.col("confidence")).alias("order"), "account", "position", "rings_appeared", "hold_hours", "received",
        "sent", "confidence", "role", "action", "is_controller",
    )
    people = roles.groupBy("ring_id").agg(F.sort_array(F.collect_list(entry)).alias("people"))

    def keep(flag: bool) -> Column:
        chosen = F.filter("people", lambda p: p["is_controller"] == F.lit(flag))
        return F.transform(chosen, lambda p: p.dropFields("order", "is_controller"))

    return (
        investigation.join(people, "ring_id", "left")
        .withColumn("controllers", keep(True))
        .withColumn("mules", keep(False))
        .drop("people")
    )


def ring_cards(selected: DataFrame, internal: DataFrame, roles: DataFrame, n: int = CARD_TRANSFERS) -> DataFrame:
    """Queue cards: summary, flow ends, first transfers and role lists."""
    named = roles.groupBy("ring_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_controller"), F.col("account")))).alias("controllers"),
        F.sort_array(F.collect_list(F.when(~F.col("is_controller"), F.col("account")))).alias("mules"),
    )
    moves = _transfer_list(internal, n, F.col("from_node").alias("from"), F.col("to_node").alias("to"))
    return (
        scan_rings(selected, internal)
        .withColumnRenamed("accounts", "account_count")
        .join(selected.select("ring_id", "accounts"), "ring_id")
        .join(_ends(selected, internal), "ring_id", "left")
        .join(moves.withColumnRenamed("transactions", "first_moves"), "ring_id", "left")
        .join(named, "ring_id", "left")
        .withColumn("pattern", F.array_join("signals", ", "))
    )


def ring_timeline(internal: DataFrame, n: int = CASE_TRANSFERS) -> DataFrame:
    """Relative time and height of a ring's listed transfers; needs two of them."""
    rows = first_transfers(internal, n).withColumn("amount", F.round("amount_paid", 2))
    ring = Window.partitionBy("ring_id")
    t0 = F.min("timestamp").over(ring)
    elapsed = F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("timestamp"))
    span = F.greatest(F.lit(1000), F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")))
    return (
        rows.withColumns(
            {"t0": t0, "t1": F.max("timestamp").over(ring), "top": F.max("amount").over(ring), "points": F.count("*").over(ring)}
        )
        .where(F.col("points") >= 2)
        .select(
            "ring_id", "place", "from_node", "to_node", "amount",
            (elapsed / span).alias("position"),
            F.try_divide("amount", "top").alias("height"),
        )
    )


def ring_shape(selected: DataFrame, internal: DataFrame) -> DataFrame:
    """Closed loop when nothing enters or leaves, otherwise a column per account."""
    at = positions(selected, internal)
    ring = Window.partitionBy("ring_id")
    ends = F.count_if(F.col("position").isin("source", "cash_out")).over(ring)
    layer = F.when(F.col("position") == "source", "source").when(F.col("position") == "cash_out", "cash_out").otherwise("middle")
    return at.withColumn("ends", ends).select(
        "ring_id",
        "account",
        F.when(F.col("ends") == 0, "closed_loop").otherwise("layered").alias("shape"),
        F.when(F.col("ends") == 0, "loop").otherwise(layer).alias("layer"),
    )


def health(rings: DataFrame, transfers: DataFrame) -> DataFrame:
    loaded = transfers.agg(F.count("*").alias("transactions_loaded"))
    return beside(rings.agg(F.count("*").alias("rings_in_queue")), loaded)
