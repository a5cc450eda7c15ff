"""Graph slices around the top rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside, money_sum
from flowtrail.operators.filters import induced_transfers
from flowtrail.operators.traversal import neighbourhood
from flowtrail.params import CONTEXT_HOPS, MAX_CONTEXT_DEGREE


def account_roles(roles: DataFrame) -> DataFrame:
    """One role per account: controller wins over mule; the ring is the best ranked one."""
    return roles.groupBy(F.col("account").alias("node")).agg(
        F.when(F.max("is_controller"), "controller").otherwise("mule").alias("role"), F.min("ring_id").alias("ring_id")
    )


def context_accounts(
    edges: DataFrame, accounts: DataFrame, flagged: DataFrame, hops: int = CONTEXT_HOPS, max_degree: int = MAX_CONTEXT_DEGREE
) -> DataFrame:
    """Neighbours of the flagged accounts that are not busy themselves."""
    quiet = accounts.where(F.col("neighbours") <= max_degree).select("node")
    near = neighbourhood(edges, flagged, hops, few=True)
    return near.join(flagged, "node", "left_anti").join(quiet, "node", "left_semi")


def slice_links(search: DataFrame, kept: DataFrame) -> DataFrame:
    return (
        induced_transfers(search, kept)
        .groupBy(F.col("from_node").alias("source"), F.col("to_node").alias("target"))
        .agg(F.round(money_sum("amount_paid"), 2).alias("amount"), F.count("*").alias("count"))
    )


def slice_nodes(links: DataFrame, flagged: DataFrame) -> DataFrame:
    """Endpoints of the links and every flagged account, with role and ring."""
    ends = links.select(F.explode(F.array("source", "target")).alias("node"))
    return (
        ends.unionByName(flagged.select("node"))
        .distinct()
        .join(flagged, "node", "left")
        .select(F.col("node").alias("id"), F.coalesce("role", F.lit("clean")).alias("role"), "ring_id")
    )


def slice_summary(flagged: DataFrame, transfers: DataFrame, hops: int = CONTEXT_HOPS) -> DataFrame:
    senders = transfers.agg(F.count_distinct("from_node").alias("distinct_senders"))
    return beside(flagged.agg(F.count("*").alias("ring_accounts")), senders).select("ring_accounts", F.lit(hops).alias("hops"), "distinct_senders")


def ring_slice_nodes(selected: DataFrame, roles: DataFrame) -> DataFrame:
    """Accounts of each ring with their role inside that ring."""
    role = F.when(F.col("is_controller"), "controller").when(~F.col("is_controller"), "mule").otherwise("clean")
    members = selected.select("ring_id", F.explode("accounts").alias("account"))
    return members.join(roles.select("ring_id", "account", "is_controller"), ["ring_id", "account"], "left").select(
        "ring_id", F.col("account").alias("id"), role.alias("role")
    )


def ring_slice_links(internal: DataFrame) -> DataFrame:
    return internal.select(
        "ring_id",
        F.col("from_node").alias("source"),
        F.col("to_node").alias("target"),
        F.round("amount_paid", 2).alias("amount"),
        F.col("payment_currency").alias("currency"),
        "timestamp",
    )


def label_anchors(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The busiest account of each ring in the slice; the smallest id on ties."""
    degree = links.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    seen = nodes.where(F.col("ring_id").isNotNull()).join(degree, "id", "left")
    best = F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), F.col("id"))
    return seen.groupBy("ring_id").agg(F.min(best).alias("b")).select(
        "ring_id", F.col("b.id").alias("anchor"), (-F.col("b.d")).alias("degree")
    )
