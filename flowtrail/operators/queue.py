"""From detector candidates to one ranked alert queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.functions.skew import attach, shuffled
from flowtrail.operators.filters import size_guard
from flowtrail.params import KIND_PRIOR, KINDS, UNKNOWN_PRIOR, DetectionParams
from flowtrail.schema import EVIDENCE
from flowtrail.session import stage

# Scores that differ only by floating-point noise are ties.
RANK_DIGITS = 9


def kind_order(kind: Column) -> Column:
    return reduce(
        lambda acc, item: acc.when(kind == item[1], F.lit(item[0])),
        enumerate(KINDS[1:], start=1),
        F.when(kind == KINDS[0], F.lit(0)),
    ).otherwise(F.lit(len(KINDS)))


def prior(kind: Column, priors: dict = KIND_PRIOR) -> Column:
    pairs = [x for k, v in priors.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(UNKNOWN_PRIOR))


def candidate_union(*detected: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, detected)


def signals_by_account(candidates: DataFrame) -> DataFrame:
    """The detector kinds touching each account, as a bit mask that partially aggregates."""
    return (
        candidates.select(F.explode("accounts").alias("account"), kind_mask(F.col("kind")).alias("bit"))
        .groupBy("account")
        .agg(F.bit_or("bit").alias("mask"), F.count("*").alias("candidates"))
    )


def kind_mask(kind: Column) -> Column:
    return reduce(
        lambda acc, item: acc.when(kind == item[1], F.lit(1 << item[0])),
        enumerate(KINDS[1:], start=1),
        F.when(kind == KINDS[0], F.lit(1)),
    ).otherwise(F.lit(0))


def mask_kinds(mask: Column) -> Column:
    """The kind names of a mask, ascending."""
    names = [F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, F.lit(k)) for i, k in enumerate(KINDS)]
    return F.array_sort(F.array_compact(F.array(*names)))


def collapse(candidates: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    """Candidates on one account set become one ring, evidence in detector order."""
    sized = size_guard(candidates, params.max_ring_accounts)
    item = F.struct(
        kind_order(F.col("kind")).alias("ord"),
        F.coalesce("evidence.hub", "evidence.node", F.lit("")).alias("anchor"),
        F.col("kind"),
        F.round("score", 3).alias("score"),
        F.col("evidence"),
    )
    merged = sized.groupBy("accounts").agg(
        F.max(prior(F.col("kind"), params.kind_prior) * F.col("score")).alias("score"),
        F.min(kind_order(F.col("kind"))).alias("first_kind"),
        F.sort_array(F.collect_list(item)).alias("items"),
    )
    flat = F.transform(
        "items",
        lambda x: F.struct(
            x["kind"].alias("kind"),
            x["score"].alias("score"),
            *[x["evidence"][f.name].alias(f.name) for f in EVIDENCE.fields],
        ),
    )
    return merged.select("accounts", "score", "first_kind", flat.alias("evidence"))


def corroborate(rings: DataFrame, candidates: DataFrame, few: bool = False) -> DataFrame:
    """Add the kinds of every candidate that touches any account of the ring.

    The masks come from all candidates, also those the size guard drops. An account in a
    great many rings is a heavy key of the join and is handled there. ``rings`` is read
    several times, so pass a table that is already ranked and written. The members of ``few``
    rings are broadcast, so that no candidate is shuffled.
    """
    members = rings.select("ring_id", F.explode("accounts").alias("account"))
    if few:
        bits = candidates.select(F.explode("accounts").alias("account"), kind_mask(F.col("kind")).alias("mask"))
        touched = bits.join(F.broadcast(members), "account")
    else:
        touched = attach(members, signals_by_account(candidates), ("account", "account"), {"mask": "mask"})
    masks = touched.groupBy("ring_id").agg(F.bit_or("mask").alias("mask"))
    return rings.join(shuffled(masks), "ring_id").withColumn("signals", mask_kinds(F.col("mask"))).drop("mask")


def rank_columns() -> list[Column]:
    return [F.round("score", RANK_DIGITS).desc(), F.col("first_kind").asc(), F.col("accounts").asc()]


def global_rank(rows: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Number rows 1..n in a total order without funnelling them through one task.

    Range-partition and sort, keep each row's place within its partition, then shift by
    the sizes of the partitions before it. The sorted table is written out first: range
    bounds come from a sample, so the places must not be recomputed.
    """
    placed = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
            "_place", F.monotonically_increasing_id()
        ),
        name,
    )
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row per partition: this window is as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(label, F.col("_offset") + local + 1)
        .drop("_part", "_offset", "_place")
    )


def ranked(candidates: DataFrame, params: DetectionParams = DetectionParams()) -> DataFrame:
    """``ring_id, score, accounts`` of the whole queue, for those that need no evidence and no signals.

    Rings are ranked, never merged by shared accounts. Evidence is many times the rest and
    would go through the grouping, the sample of the range bounds and the sort.
    """
    rings = size_guard(candidates, params.max_ring_accounts).groupBy("accounts").agg(
        F.max(prior(F.col("kind"), params.kind_prior) * F.col("score")).alias("score"),
        F.min(kind_order(F.col("kind"))).alias("first_kind"),
    )
    return global_rank(rings, rank_columns(), "queue-order", "ring_id").select("ring_id", "score", "accounts")


def combine(
    candidates: DataFrame, params: DetectionParams = DetectionParams(), order: DataFrame | None = None
) -> DataFrame:
    """The whole ranked queue; ``order`` is its ``ranked`` table, if there is one already."""
    rings = corroborate(ranked(candidates, params) if order is None else order, candidates)
    proofs = collapse(candidates, params).select("accounts", "evidence")
    return rings.join(shuffled(proofs), "accounts").select(
        "ring_id", "score", "accounts", "signals", "evidence", F.size("accounts").alias("account_count")
    )


def head(order: DataFrame, candidates: DataFrame, k: int, params: DetectionParams = DetectionParams()) -> DataFrame:
    """The first ``k`` rings of a ``ranked`` queue as ``combine`` gives them; candidates are only scanned."""
    top = stage(top_k(order, k), "queue-head")
    same = candidates.join(F.broadcast(top.select("accounts")), "accounts", "left_semi")
    proofs = collapse(same, params).select("accounts", "evidence")
    return corroborate(top, candidates, few=True).join(proofs, "accounts").select(
        "ring_id", "score", "accounts", "signals", "evidence", F.size("accounts").alias("account_count")
    )


def top_rings(candidates: DataFrame, k: int, params: DetectionParams = DetectionParams()) -> DataFrame:
    """Only the head of the queue: a top-k selection, then corroboration of k rings."""
    head = collapse(candidates, params).orderBy(*rank_columns()).limit(k)
    place = F.row_number().over(Window.orderBy(*rank_columns())).cast("bigint")
    ranked = stage(head.withColumn("ring_id", place), "queue-head")
    return corroborate(ranked, candidates).select(
        "ring_id", "score", "accounts", "signals", "evidence", F.size("accounts").alias("account_count")
    )


def top_k(rings: DataFrame, k: int) -> DataFrame:
    return rings.where(F.col("ring_id") <= k)


def cross_ring_counts(rings: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """In how many rings of the whole queue each account appears; only the accounts ``among`` a few ones, if given."""
    members = rings.select(F.explode("accounts").alias("account"))
    if among is not None:
        members = members.join(F.broadcast(among.select("account").distinct()), "account", "left_semi")
    return members.groupBy("account").agg(F.count("*").alias("rings_appeared"))


def detector_report(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("kind").agg(F.count("*").alias("candidates"))


def corroboration_report(rings: DataFrame) -> DataFrame:
    return rings.agg(
        F.count("*").alias("rings"),
        F.count_if(F.size("signals") >= 2).alias("two_or_more_signals"),
        F.count_if(F.size("signals") >= 3).alias("three_or_more_signals"),
    )
