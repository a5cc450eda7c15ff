"""Neighbourhoods and weak components over the edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.skew import attach, shuffled
from flowtrail.session import release, scratch_path, stage


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1, few: bool = False) -> DataFrame:
    """Graph accounts within ``hops`` steps of the seeds, direction ignored.

    Seeds that are not in the graph are left out, as an induced subgraph would. ``few`` seeds
    are broadcast to find their ends and the first hop, so that no edge is shuffled.
    """
    ends = edges.select(F.explode(F.array("from_node", "to_node")).alias("node"))
    start = seeds.select("node").distinct()
    if few:
        seen = ends.join(F.broadcast(start), "node", "left_semi").distinct()
        # Read by every hop, and of a size that is known.
        seen = stage(seen, "seeds")
    else:
        seen = start.join(ends, "node", "left_semi")
    frontier = seen
    for hop in range(hops):
        near = F.broadcast(frontier) if few and hop == 0 else frontier
        out = edges.join(near, F.col("from_node") == F.col("node"), "left_semi").select(
            F.col("to_node").alias("node")
        )
        back = edges.join(near, F.col("to_node") == F.col("node"), "left_semi").select(
            F.col("from_node").alias("node")
        )
        frontier = out.unionByName(back).distinct().join(seen, "node", "left_anti")
        if hop < hops - 1:
            frontier = stage(frontier, "frontier")
        seen = seen.unionByName(frontier)
    return seen


#: Neighbours of an account in one slot of the adjacency table, and rows in one of its buckets.
SLOT_ROWS, BUCKET_ROWS = 100_000, 2_000_000


class Adjacency:
    """Every account's neighbours, direction ignored, kept where a hop finds them without a shuffle of edges.

    The table is bucketed and sorted by account and slot. An account with very many
    neighbours has several slots, dealt by the neighbour, so a hub fills no bucket. A hop
    shuffles the frontier, a row per account and slot, to the buckets and reads these in
    place. Bucketed tables need a name in the catalog; files lie in the shared folder.
    """

    def __init__(self, pairs: DataFrame, slot_rows: int = SLOT_ROWS, bucket_rows: int = BUCKET_ROWS):
        spark = pairs.sparkSession
        links = stage(
            pairs.where(F.col("from_node") != F.col("to_node")).select(
                F.explode(
                    F.array(
                        F.struct(F.col("from_node").alias("node"), F.col("to_node").alias("next")),
                        F.struct(F.col("to_node").alias("node"), F.col("from_node").alias("next")),
                    )
                ).alias("l")
            ).select("l.*").distinct(),
            "adjacent",
        )
        sizes = links.groupBy("node").agg(F.ceil(F.count("*") / slot_rows).cast("int").alias("slots"))
        self.accounts = stage(sizes, "adjacent-accounts")
        self.buckets = max(1, -(-links.count() // bucket_rows))
        # Only accounts of several slots need their number; they are few.
        many = self.accounts.where("slots > 1")
        slot = F.pmod(F.xxhash64("next"), F.coalesce("slots", F.lit(1))).cast("int")
        placed = links.join(many, "node", "left").select("node", slot.alias("slot"), "next")
        self.name = f"adjacency_{uuid.uuid4().hex[:12]}"
        (
            placed.repartition(self.buckets, "node", "slot").write.bucketBy(self.buckets, "node", "slot").sortBy("node", "slot")
            .option("path", scratch_path(spark, "adjacency")).format("parquet").saveAsTable(self.name)
        )
        self.table = spark.table(self.name)

    def hop(self, frontier: DataFrame) -> DataFrame:
        """Distinct neighbours of the accounts of a frontier (node, distinct)."""
        asked = frontier.join(self.accounts, "node").select("node", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
        return asked.join(self.table, ["node", "slot"]).select(F.col("next").alias("node")).distinct()

    def neighbourhood(self, seeds: DataFrame, hops: int = 1) -> DataFrame:
        """Accounts with neighbours within ``hops`` steps of the seeds; seeds without any are left out."""
        seen = stage(seeds.select("node").distinct().join(self.accounts, "node", "left_semi"), "frontier")
        frontier = seen
        for _ in range(hops):
            frontier = stage(self.hop(frontier).join(seen, "node", "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
        return seen

    def release(self) -> None:
        release(self.table)
        self.table.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    keep = nodes.select(F.col("node").alias("_n"))
    return edges.join(keep, F.col("from_node") == F.col("_n"), "left_semi").join(
        keep, F.col("to_node") == F.col("_n"), "left_semi"
    )


def account_id(account: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), account)


def telling_seed(nodes: DataFrame, tries: int = 8) -> int:
    """A seed whose 64-bit hash tells all accounts apart, so that links can carry longs without a join.

    ``nodes`` holds an account once. Of a hundred million accounts two share a hash for one seed in some four thousand.
    """
    for seed in range(tries):
        if nodes.groupBy(account_id("node", seed).alias("id")).agg(F.count("*").alias("n")).where("n > 1").count() == 0:
            return seed
    raise ValueError("accounts must be distinct")


def account_links(pairs: DataFrame, seed: int) -> DataFrame:
    """``u, v, ways``: every linked pair of accounts once, the larger hash first, and in how many directions it is linked."""
    start, end = account_id("from_node", seed), account_id("to_node", seed)
    ends = pairs.where(F.col("from_node") != F.col("to_node")).select(start.alias("a"), end.alias("b"))
    return ends.groupBy(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).agg(
        (F.max((F.col("a") > F.col("b")).cast("int")) + F.max((F.col("a") < F.col("b")).cast("int"))).alias("ways")
    )


def contracted_components(links: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """``id, component`` with the smallest id, for all ids of ``links`` (u, v: longs, u > v, distinct).

    Local contraction (Lacki, Mirrokni, Wlodarczyk 2018): in every round each account goes to
    the one of smallest hash among itself and its neighbours, and links are drawn between
    the accounts gone to. The account of largest hash of a component is never gone to, so
    every round has fewer accounts, on average by a constant factor, until no link is left;
    ``sizes`` is given the number of links of each round. Names of the components then go
    back through the rounds. Rounds write their own tables, so a lost executor costs its tasks.
    """
    rounds = []
    # Smallest id that stands behind each account of the round.
    least = None
    while True:
        number, n = len(rounds), links.count()
        if sizes is not None:
            sizes.append(n)
        if n == 0:
            break
        hashed = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("id"))
        ends = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = ends.groupBy("u").agg(F.min(hashed("v")).alias("best"))
        gone = best.select(F.col("u").alias("id"), F.least(F.col("best"), hashed("u")).getField("id").alias("leader"))
        gone = gone.withColumn("least", F.col("id")) if least is None else gone.join(least, "id")
        gone = stage(gone, "component-leaders")
        least = stage(gone.groupBy(F.col("leader").alias("id")).agg(F.min("least").alias("least")), "component-least")
        to = gone.select("id", "leader")
        old = links
        moved = links.join(to.toDF("u", "lu"), "u").join(to.toDF("v", "lv"), "v").where("lu != lv")
        links = stage(moved.select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct(), "component-links")
        if rounds:
            release(old)
        rounds.append((gone, least))
    names = None
    for gone, least in reversed(rounds):
        # What the account gone to is called: by later rounds, or, if it has no link there, by its smallest id.
        called = least.select(F.col("id").alias("leader"), F.col("least").alias("component"))
        if names is not None:
            later = names.select(F.col("id").alias("leader"), F.col("component").alias("later"))
            called = called.join(later, "leader", "left").select("leader", F.coalesce("later", "component").alias("component"))
        names = stage(gone.select("id", "leader").join(called, "leader").select("id", "component"), "component-names")
    if names is None:
        return links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return names


def component_members(nodes: DataFrame, seed: int, found: DataFrame) -> DataFrame:
    """``node, component`` for every account; those without a link are components of their own."""
    ids = nodes.select("node", account_id("node", seed).alias("id"))
    return ids.join(shuffled(found), "id", "left").select("node", F.coalesce("component", "id").alias("component"))


def named_components(members: DataFrame) -> DataFrame:
    """Components called by their smallest account. ``members`` is read three times."""
    names = members.groupBy("component").agg(F.min("node").alias("name"))
    # Most accounts may lie in one component.
    return attach(members, names, ("component", "component"), {"name": "name"}).select("node", F.col("name").alias("component"))


def weak_components(pairs: DataFrame, nodes: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """``node, component`` with the smallest account id as the component's name.

    ``pairs`` holds account pairs in either direction, or both, any number of times; accounts
    without a link to another one are components of their own.
    """
    seed = telling_seed(nodes)
    links = stage(account_links(pairs, seed), "account-links")
    members = component_members(nodes, seed, contracted_components(links.select("u", "v"), sizes))
    return named_components(stage(members, "component-members"))
