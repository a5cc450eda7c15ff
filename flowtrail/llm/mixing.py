"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get shares of all words by weight, bounded by how often a source may repeat. The
shares are turned into whole numbers of equal-token blocks by highest quotients, first
among sources, then among the shards of each source. In a shard the documents lie one
after another in seeded order, cut into blocks, and a seeded run of blocks is taken.

Only DataFrame expressions are used. Work per document is one window inside its shard,
and a shard holds ``shard_tokens`` words or one longer document, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.llm.common import n_words
from flowtrail.session import stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
# Words of all documents over this many blocks, at least one word, make a block.
BLOCKS = 1 << 24
SHARD_TOKENS = 1 << 21


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``rank``, ``all_size`` and ``target`` to a table (source, source_size) with a row per source.

    Weights go round the sources in code point order, null last. Targets share the sum of
    all sizes by weight; a target stops at ``repeat`` times its source's size and what it
    leaves is shared by weight among the others until none is above. That is a common level
    times the weight, cut at the bound: with sources in order of bound over weight, it is
    the level at the first source that is not cut.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("bound") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(rising), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0))
    )
    return (
        sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("bound", F.col("source_size") * repeat)
        .withColumn("level", level)
        .withColumn("free", F.max(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.col("level"))).over(everything))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn(
            "target",
            F.least(F.col("bound").cast("double"), F.coalesce(F.col("free") * F.col("weight"), F.col("bound").cast("double"))),
        )
        .select("source", "source_size", "rank", "all_size", "target")
    )


def sainte_lague(rows: DataFrame, within: list[str], key: str, share: str, seats: str) -> DataFrame:
    """Adds ``quota``: ``seats`` whole seats per group ``within`` go to the highest quotients share / (2k + 1).

    A lower divisor bound gives every row the seats it is sure of; only the quotients
    between the two bounds, at most two per row, are ranked. Ties go to the smaller key.
    """
    group = Window.partitionBy(*within)
    total, half = F.sum(share).over(group), F.count("*").over(group) / 2

    def sure(n: Column) -> Column:
        return F.greatest(F.lit(0), F.coalesce(F.floor(F.try_divide(F.col(share) * n, total) + 0.5), F.lit(0))).cast("long")

    bounds = rows.withColumn("_low", sure(F.col(seats) - half)).withColumn("_high", sure(F.col(seats) + half))
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    best = Window.partitionBy(*within).orderBy(F.col("_quotient").desc(), key)
    more = (
        bounds.where("_high > _low")
        .select(*within, key, share, "_left", F.explode(F.expr("sequence(_low, _high - 1)")).alias("_k"))
        .withColumn("_quotient", F.col(share) / (2 * F.col("_k") + 1))
        .withColumn("_place", F.row_number().over(best))
        .where("_place <= _left and _quotient > 0")
        .groupBy(*within, key)
        .agg(F.count("*").alias("_more"))
    )
    return bounds.join(more, [*within, key], "left").select(
        *rows.columns, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias("quota")
    )


def overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeat: int = MAX_REPEAT,
    blocks: int = BLOCKS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = 42,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of every document the mix takes.

    Returns a row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size,
    target, taken, source, ``skip`` (words before the taken part where less than the whole
    document is taken in the last round) and, if there are any, the ``carry`` columns as
    one struct ``carried``.

    A null source is a source of its own; null and empty texts have size 0 and are taken 0
    times; null ids are ordinary ids; repeated rows are rows of their own, their order does
    not matter as they are equal. An empty table gives no rows. Columns not named here are
    left out, whatever they are called.
    """
    size = n_words(F.col("text"))
    tie = F.xxhash64("text")
    light = stage(docs.select("source", size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_source = targets(light, weights, repeat)
    block = F.greatest(F.lit(1), F.floor(F.col("all_size") / blocks)).cast("long")
    plan = by_source.withColumn("block", block).withColumn("seats", F.ceil(F.col("all_size") / F.col("block")).cast("long"))
    plan = sainte_lague(plan, [], "rank", "target", "seats").withColumn(
        "n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long")
    )
    plan = stage(plan, "source_plan")

    rows = docs.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), size.alias("_size"), tie.alias("_tie"),
        *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    )
    if not carry:
        rows = stage(rows, "sizes")
    dealt = rows.join(plan, F.col("_source").eqNullSafe(F.col("source"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed), "_id", "_size", "_tie"), F.col("n_shards"))
    )
    light_dealt = dealt if not carry else dealt.drop(*[f"_carry_{i}" for i in range(len(carry))])
    shards = (
        light_dealt.groupBy("rank", "shard")
        .agg(F.sum("_size").alias("shard_size"), F.first("quota").alias("source_quota"), F.first("block").alias("block"))
    )
    shards = sainte_lague(shards, ["rank"], "shard", "shard_size", "source_quota")
    n_blocks = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    shards = shards.select(
        "rank", "shard", "shard_size", n_blocks.alias("n_blocks"),
        F.least(F.col("quota"), repeat * n_blocks).alias("shard_quota"),
    )
    shards = stage(shards, "shard_plan")

    seeded = Window.partitionBy("rank", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "_id", "_size", "_tie"), "_id", "_size", "_tie"
    )
    laid = (
        dealt.withColumn("end", F.sum("_size").over(seeded.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("start", F.col("end") - F.col("_size"))
        .join(shards, ["rank", "shard"])
        .withColumn("rounds", F.coalesce(F.floor(F.try_divide(F.col("shard_quota"), F.col("n_blocks"))), F.lit(0)).cast("long"))
        .withColumn("rest", F.coalesce(F.expr("try_mod(shard_quota, n_blocks)"), F.lit(0)))
        .withColumn("from", F.coalesce(F.expr(f"pmod(xxhash64({int(seed)}L, rank, shard), nullif(n_blocks, 0))"), F.lit(0)))
    )
    low, high = F.col("from") * F.col("block"), (F.col("from") + F.col("rest")) * F.col("block")
    line = F.col("n_blocks") * F.col("block")
    head = overlap(F.col("start"), F.col("end"), low, F.least(high, line))
    wrapped = overlap(F.col("start"), F.col("end"), F.lit(0), high - line)
    return laid.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("rounds") * F.col("_size") + head + wrapped).alias("taken"),
        F.col("_source").alias("source"),
        F.when(wrapped > 0, F.lit(0)).otherwise(F.greatest(F.lit(0), low - F.col("start"))).alias("skip"),
        *([F.struct(*[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)]).alias("carried")] if carry else []),
    )
