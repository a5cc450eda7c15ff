"""Joins that hold when one key owns a large share of the rows.

A key is *heavy* when its weight exceeds ``total / MAX_HEAVY_KEYS``. There can be at
most MAX_HEAVY_KEYS such keys whatever the size of the data, which is what makes
broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HEAVY_KEYS = 20_000
# ``attach`` finds its heavy keys by sketch: at most so many, each with more than a 1 / SKETCH_KEYS of the rows.
SKETCH_KEYS = 2_000
# Counters of a sketch. Counts are too high by at most 3.5 / (4 / 3 * counters) of the rows, under a third of the limit.
SKETCH_ITEMS = 16_384
# Sketches are merged in two steps, so many at a time.
SKETCH_GROUPS = 64
# Below this many rows a single key is no burden for one task.
LIGHT_ROWS = 200_000


def shuffled(table: DataFrame) -> DataFrame:
    """A table that grows with the input, marked as a side of a join to be shuffled and sorted at any size.

    Spark's guess at a table's size is that of its compressed, pruned files: rows exploded from
    arrays, or strings that repeat, can be fifty times as large once the driver has to build a
    broadcast from them. AQE still splits the skewed partitions of such a join.
    """
    return table.hint("merge")


def heavy_keys(counts: DataFrame, weight: str, total: int | None = None) -> DataFrame:
    """The rows of a one-row-per-key table whose key is heavy."""
    if total is None:
        share = counts.agg((F.sum(weight) / MAX_HEAVY_KEYS).alias("share")).scalar()
        limit = F.greatest(F.lit(float(LIGHT_ROWS)), share)
    else:
        limit = F.lit(max(float(LIGHT_ROWS), total / MAX_HEAVY_KEYS))
    return counts.where(F.col(weight) > limit)


def drop_heavy(
    rows: DataFrame, key: str, counts: DataFrame, counts_key: str, weight: str, needed: int
) -> DataFrame:
    """Remove rows of heavy keys map-side, before they can fill one shuffle partition.

    For keys the caller discards anyway: those with more than ``needed`` rows.
    """
    heavy = heavy_keys(counts, weight).where(F.col(weight) > needed).select(F.col(counts_key).alias(key))
    return rows.join(F.broadcast(heavy), key, "left_anti")


def frequent_hashes(keys: DataFrame, key: str) -> DataFrame:
    """``_hash``: 64-bit hashes of the keys that own more than ``total / SKETCH_KEYS`` rows.

    One pass with a mergeable sketch of frequent items, a fixed number of counters a task. Its
    counts are never too low, so no such key is missed; keys a little below the limit may be
    among the result, which holds at most SKETCH_KEYS rows.
    """
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h"))
    some = hashed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_g")).agg(
        F.expr(f"approx_top_k_accumulate(_h, {SKETCH_ITEMS})").alias("_s"), F.count("*").alias("_n")
    )
    # Grouped, by the same value for all, so that an empty partition has no sketch.
    whole = some.groupBy(F.pmod("_g", F.lit(1)).alias("_g")).agg(F.expr(f"approx_top_k_combine(_s, {SKETCH_ITEMS})").alias("_s"), F.sum("_n").alias("_n"))
    found = whole.select(F.explode(F.expr(f"approx_top_k_estimate(_s, {SKETCH_KEYS})")).alias("_e"), "_n")
    limit = F.greatest(F.lit(float(LIGHT_ROWS)), F.col("_n") / SKETCH_KEYS)
    return found.where(F.col("_e.count") > limit).select(F.col("_e.item").alias("_hash"))


def attach(
    rows: DataFrame, lookup: DataFrame, on: tuple[str, str], values: dict[str, str], keys_from: DataFrame | None = None
) -> DataFrame:
    """Left many-to-one join of ``rows`` with a one-row-per-key ``lookup``.

    ``values`` maps lookup columns to output names. Rows of heavy keys, whether the lookup
    holds the key or not, get their values from a broadcast of about SKETCH_KEYS rows at most;
    they and rows without a key are dealt out evenly by the shuffle in which the others
    meet the lookup. No job runs while the plan is built. ``rows`` is read twice: once for
    the sketch of its keys, once to join. ``keys_from`` is a cheaper table with the same keys
    as often for the sketch, such as the one that ``rows`` was made from.
    """
    row_key, lookup_key = on
    names = list(values.items())
    known = lookup.select(
        F.col(lookup_key).alias("_lk"), *[F.col(c).alias(f"_v_{i}") for i, (c, _) in enumerate(names)]
    )
    hot = frequent_hashes(rows if keys_from is None else keys_from, row_key)
    heavy = known.withColumn("_hash", F.xxhash64("_lk")).join(F.broadcast(hot), "_hash", "left_semi").drop("_hash")
    heavy = heavy.toDF("_hk", *[f"_h_{i}" for i in range(len(names))])
    flags = hot.select(F.col("_hash"), F.lit(True).alias("_hot"))
    seen = rows.withColumn("_hash", F.xxhash64(row_key)).join(F.broadcast(flags), "_hash", "left").drop("_hash")
    seen = seen.join(F.broadcast(heavy), F.col("_hot") & (F.col(row_key) == F.col("_hk")), "left")
    apart = F.col("_hot") | F.col(row_key).isNull()
    # Rows that need no lookup never match, and the second join column spreads them.
    seen = seen.withColumn("_salt", F.when(apart, 1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))).otherwise(F.lit(0).cast("bigint")))
    # Always 0, but not a constant that the optimizer would take out of the join's keys.
    known = known.withColumn("_none", F.pmod(F.xxhash64("_lk"), F.lit(1)))
    joined = seen.join(shuffled(known), (F.col(row_key) == F.col("_lk")) & (F.col("_salt") == F.col("_none")), "left")
    return joined.select(
        *rows.columns,
        *[F.when(F.col("_hot"), F.col(f"_h_{i}")).otherwise(F.col(f"_v_{i}")).alias(name) for i, (_, name) in enumerate(names)],
    )
