"""Account graph: directed edges and accounts as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside, money_sum
from flowtrail.functions.skew import attach
from flowtrail.operators.filters import self_payments, without_self_payments


def edge_table(transfers: DataFrame) -> DataFrame:
    """One row per ordered account pair; self-payments excluded."""
    return (
        without_self_payments(transfers)
        .groupBy("from_node", "to_node")
        .agg(
            F.count("*").alias("count"),
            money_sum("amount_paid").alias("total_amount"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def node_table(transfers: DataFrame) -> DataFrame:
    """Every account with its number of self-payments, including self-only accounts."""
    is_self = F.col("from_node") == F.col("to_node")
    ends = transfers.select(
        F.explode(
            F.when(is_self, F.array(F.struct(F.col("from_node").alias("node"), F.lit(1).alias("loop")))).otherwise(
                F.array(
                    F.struct(F.col("from_node").alias("node"), F.lit(0).alias("loop")),
                    F.struct(F.col("to_node").alias("node"), F.lit(0).alias("loop")),
                )
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.node").alias("node")).agg(
        F.sum("e.loop").cast("bigint").alias("self_loop_count")
    )


def pair_table(transfers: DataFrame) -> DataFrame:
    """Directed edges with amount moments and a reciprocity flag, in a single shuffle.

    Transfers are aggregated per *unordered* pair with one set of conditional aggregates
    per direction, so whether the reverse edge exists is known without a self-join.
    Sums of squares are kept as deviations from the edge mean (``m2``).
    """
    rows = without_self_payments(transfers)
    up = F.col("from_node") < F.col("to_node")
    amount = F.col("amount_paid")

    def direction(cond, tag):
        value = F.when(cond, amount)
        when = F.when(cond, F.col("timestamp"))
        return [
            F.count_if(cond).alias(f"{tag}_count"),
            money_sum(value).alias(f"{tag}_total"),
            F.min(when).alias(f"{tag}_first"),
            F.max(when).alias(f"{tag}_last"),
            F.avg(value).alias(f"{tag}_mean"),
            F.var_pop(value).alias(f"{tag}_var"),
        ]

    both = rows.groupBy(
        F.least("from_node", "to_node").alias("low"), F.greatest("from_node", "to_node").alias("high")
    ).agg(*direction(up, "up"), *direction(~up, "down"))

    def edge(src, dst, tag):
        return F.struct(
            F.col(src).alias("from_node"),
            F.col(dst).alias("to_node"),
            F.col(f"{tag}_count").alias("count"),
            F.col(f"{tag}_total").alias("total_amount"),
            F.col(f"{tag}_first").alias("first_seen"),
            F.col(f"{tag}_last").alias("last_seen"),
            F.col(f"{tag}_mean").alias("mean_amount"),
            (F.col(f"{tag}_var") * F.col(f"{tag}_count")).alias("m2"),
        )

    return (
        both.withColumn("reciprocal", (F.col("up_count") > 0) & (F.col("down_count") > 0))
        .select(
            "reciprocal",
            F.explode(F.array(edge("low", "high", "up"), edge("high", "low", "down"))).alias("e"),
        )
        .where(F.col("e.count") > 0)
        .select("e.*", "reciprocal")
    )


def account_table(pairs: DataFrame) -> DataFrame:
    """One row per account with its activity in each direction, from the edges."""

    def side(node, outgoing):
        zero, none = F.lit(0).cast("bigint"), F.lit(None)
        count, total = F.col("count"), F.col("total_amount")
        mine = {True: (count, total, F.col("first_seen"), F.col("last_seen"))}
        mine[False] = (zero, F.lit(0.0), none.cast("timestamp_ntz"), none.cast("timestamp_ntz"))
        out, inn = mine[outgoing], mine[not outgoing]
        return F.struct(
            F.col(node).alias("node"),
            F.lit(1 if outgoing else 0).alias("out_edge"),
            F.lit(0 if outgoing else 1).alias("in_edge"),
            # A reciprocal neighbour is counted once, on its outgoing edge.
            (F.lit(outgoing) | ~F.col("reciprocal")).cast("int").alias("neighbour"),
            *[
                c.alias(f"{tag}_{name}")
                for tag, cols in (("out", out), ("in", inn))
                for name, c in zip(("rows", "total", "first", "last"), cols)
            ],
        )

    ends = pairs.select(
        F.explode(F.array(side("from_node", True), side("to_node", False))).alias("s")
    ).select("s.*")
    return ends.groupBy("node").agg(
        F.sum("out_edge").alias("out_degree"),
        F.sum("in_edge").alias("in_degree"),
        F.sum("neighbour").alias("neighbours"),
        *[
            agg
            for tag in ("out", "in")
            for agg in (
                F.sum(f"{tag}_rows").alias(f"{tag}_rows"),
                money_sum(f"{tag}_total").alias(f"{tag}_total"),
                F.min(f"{tag}_first").alias(f"{tag}_first"),
                F.max(f"{tag}_last").alias(f"{tag}_last"),
            )
        ],
    )


def enriched_edges(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Edges carrying the statistics of both ends that detectors filter on.

    With the degrees on the edge, a hub outside a detector's band is dropped before the
    detector's shuffle, and triangle search can start from the smaller end.
    """
    sized = accounts.withColumn("degree", F.col("out_degree") + F.col("in_degree"))
    stats = sized.withColumn("out_mean", F.try_divide("out_total", "out_rows")).withColumn(
        "in_mean", F.try_divide("in_total", "in_rows")
    )
    with_from = attach(
        pairs,
        stats,
        ("from_node", "node"),
        {"degree": "from_degree", "out_degree": "from_out_degree", "in_degree": "from_in_degree", "out_mean": "from_out_mean"},
    )
    return attach(
        with_from,
        stats,
        ("to_node", "node"),
        {"degree": "to_degree", "in_degree": "to_in_degree", "out_degree": "to_out_degree", "in_mean": "to_in_mean"},
        keys_from=pairs,
    )


def undirected_degree(pairs: DataFrame) -> DataFrame:
    """Distinct neighbours of each account, ignoring direction."""
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("from_node").alias("node"), F.lit(1).alias("one")),
                F.struct(F.col("to_node").alias("node"), (~F.col("reciprocal")).cast("int").alias("one")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.one").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame, components: DataFrame, ways: str | None = None) -> DataFrame:
    """Size of the graph and of its weak components (``node, component`` rows); ``ways`` counts the directions of a row of ``edges``."""
    nodes = nodes.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("self_loop_count") > 0).alias("self_loop_nodes")
    )
    edges = edges.agg((F.count("*") if ways is None else F.coalesce(F.sum(ways), F.lit(0))).alias("edges"))
    sizes = (
        components.groupBy("component")
        .agg(F.count("*").alias("members"))
        .agg(F.count("*").alias("weakly_connected_components"), F.max("members").alias("largest_component"))
    )
    return beside(nodes, edges, sizes).select(
        "nodes", "edges", "self_loop_nodes", "weakly_connected_components", "largest_component"
    )
