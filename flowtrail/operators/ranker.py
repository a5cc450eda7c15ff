"""Learned ordering of detector candidates, validated on held-out rings.

The models of all splits are grown together, see ``boosting``; features, splits, scoring and
every metric are DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside
from flowtrail.functions.skew import attach, shuffled
from flowtrail.operators import boosting
from flowtrail.operators.queue import global_rank, kind_order, prior
from flowtrail.params import KINDS, PRECISION_DEPTHS
from flowtrail.session import stage

# The features, in order.
NUMERIC = (
    "score",
    "size",
    "degree",
    "tightness",
    "uniformity",
    "total_amount",
    "hold_hours",
    "amount_in",
    "cycle_length",
)
FEATURES = NUMERIC + tuple(f"kind_{k}" for k in KINDS)
HOLDOUT = 0.3


@dataclass(frozen=True)
class RankerParams:
    splits: int = 8
    iterations: int = 250
    learning_rate: float = 0.06
    depth: int = 4
    bins: int = 64

    def boosting(self) -> boosting.BoostParams:
        return boosting.BoostParams(rounds=self.iterations, rate=self.learning_rate, depth=self.depth, bins=self.bins)


def candidate_key() -> Column:
    """Identity of a candidate: kind, anchor account and account set."""
    anchor = F.coalesce("evidence.hub", "evidence.node", F.lit(""))
    return F.md5(F.concat_ws("|", F.col("kind"), anchor, F.array_join("accounts", ",")))


def featurise(candidates: DataFrame) -> DataFrame:
    """One row per candidate; a feature its detector does not produce is NULL."""
    e = F.col("evidence")
    log = lambda c: F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))
    return candidates.select(
        candidate_key().alias("cand_key"),
        "kind",
        "accounts",
        "evidence",
        F.col("score"),
        F.size("accounts").cast("double").alias("size"),
        e["degree"].cast("double").alias("degree"),
        e["tightness"].alias("tightness"),
        e["uniformity"].alias("uniformity"),
        log(e["total_amount"]).alias("total_amount"),
        e["hold_hours"].alias("hold_hours"),
        log(e["amount_in"]).alias("amount_in"),
        e["length"].cast("double").alias("cycle_length"),
        *[(F.col("kind") == k).cast("double").alias(f"kind_{k}") for k in KINDS],
    )


def heuristic(score: Column, kind: Column) -> Column:
    return prior(kind) * score


def account_ring(truth_accounts: DataFrame) -> DataFrame:
    """The lowest labelled ring of each account."""
    return truth_accounts.groupBy("account").agg(F.min("ring_id").alias("ring_id"))


def touched_ring(candidates: DataFrame, truth_accounts: DataFrame) -> DataFrame:
    """``cand_key, touched``: the lowest labelled ring a candidate touches, or -1."""
    # The 16 bytes of a key are shuffled with every account, not their 32 digits.
    keyed = candidates.select(F.unhex(candidate_key()).alias("key"), F.explode("accounts").alias("account"))
    looked = attach(keyed, account_ring(truth_accounts), ("account", "account"), {"ring_id": "ring_id"})
    found = looked.groupBy("key").agg(F.coalesce(F.min("ring_id"), F.lit(-1)).alias("touched"))
    return found.select(F.lower(F.hex("key")).alias("cand_key"), "touched")


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the MD5 of its parts; any SQL engine can repeat it."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def held_out_rings(rings: DataFrame, splits: int, share: float = HOLDOUT) -> DataFrame:
    """``split, ring_id`` of the rings (one column, distinct) held out whole: the first 30 % in hash order.

    Exact ranks from two levels: hash buckets are counted, and only within a bucket are
    rings sorted, so no task sees all rings of a split.
    """
    hashed = rings.select(
        "ring_id", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split")
    ).withColumn("hash", F.md5(F.concat_ws(":", F.col("split").cast("string"), F.col("ring_id").cast("string"))))
    hashed = hashed.withColumn("bucket", F.substring("hash", 1, 3))
    sizes = hashed.groupBy("split", "bucket").agg(F.count("*").alias("n"))
    per_split = Window.partitionBy("split")
    before = per_split.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4096 buckets a split.
    offsets = sizes.select(
        "split",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.floor(F.sum("n").over(per_split) * F.lit(share)).alias("quota"),
    )
    place = F.row_number().over(Window.partitionBy("split", "bucket").orderBy("hash", "ring_id"))
    return (
        hashed.withColumn("place", place)
        .join(offsets, ["split", "bucket"])
        .where(F.col("place") + F.col("before") <= F.col("quota"))
        .select("split", "ring_id")
    )


def touched_rings(touched: DataFrame) -> DataFrame:
    return touched.where(F.col("touched") >= 0).select(F.col("touched").alias("ring_id")).distinct()


def split_table(touched: DataFrame, splits: int, rings: DataFrame | None = None) -> DataFrame:
    """``cand_key, touched, held_out``: the splits in which a candidate is test data.

    Rings are drawn from those that candidates touch, or from ``rings``, such as all labelled
    ones, of which some no candidate touches.
    """
    held = held_out_rings(touched_rings(touched) if rings is None else rings, splits).groupBy("ring_id").agg(F.collect_list("split").alias("of_ring"))
    of_ring = F.coalesce(F.array_sort("of_ring"), F.array().cast("array<int>"))
    own = F.filter(
        F.sequence(F.lit(0), F.lit(splits - 1)),
        lambda s: unit(s, F.col("cand_key")) < F.lit(HOLDOUT),
    )
    labelled = attach(touched, held, ("touched", "ring_id"), {"of_ring": "of_ring"})
    return labelled.select(
        "cand_key", "touched", F.when(F.col("touched") >= 0, of_ring).otherwise(own).alias("held_out")
    )


def split_report(table: DataFrame, held: DataFrame) -> DataFrame:
    """``split, rings_held, train, tests, positives, base_rate``: what each split holds out, and the share a random order would hit."""
    splits = held.groupBy("split").agg(F.count("*").alias("rings_held"))
    total = table.agg(F.count("*").alias("candidates"))
    per = table.select("touched", F.explode("held_out").alias("split")).groupBy("split").agg(
        F.count("*").alias("tests"), F.count_if(F.col("touched") >= 0).alias("positives")
    )
    return beside(splits.join(per, "split"), total).select(
        "split", "rings_held", (F.col("candidates") - F.col("tests")).alias("train"), "tests", "positives",
        F.round(F.col("positives") / F.col("tests"), 6).alias("base_rate"),
    )


def training_table(candidates: DataFrame, truth_accounts: DataFrame, splits: int) -> DataFrame:
    """Features, label, heuristic score and split membership of every candidate.

    Labels and splits are written first, so that what was shuffled for them is gone when the features meet them.
    """
    table = stage(split_table(touched_ring(candidates, truth_accounts), splits), "splits")
    return (
        featurise(candidates)
        .drop("evidence")
        .join(shuffled(table), "cand_key")
        .withColumn("label", (F.col("touched") >= 0).cast("double"))
        .withColumn("heuristic", heuristic(F.col("score"), F.col("kind")))
    )


def fit(training: DataFrame, params: RankerParams = RankerParams()) -> boosting.Forest:
    """The boosted trees of every split; an absent feature is a missing value, whose side each cut learns."""
    return boosting.fit(training, FEATURES, params.splits, params.boosting())


def train_and_score(training: DataFrame, params: RankerParams = RankerParams(), forest: boosting.Forest | None = None) -> DataFrame:
    """Every candidate with the probability of each split's model and their mean."""
    scored = (forest or fit(training, params)).score(training, [f"p_{s}" for s in range(params.splits)])
    total = sum((F.col(f"p_{s}") for s in range(1, params.splits)), F.col("p_0"))
    return stage(scored.withColumn("learned", total / params.splits), "ranker-scores")


def precision_at(scored: DataFrame, rankers: dict[str, Column], ks=PRECISION_DEPTHS) -> DataFrame:
    """``split, ranker, k, precision`` over each split's held-out candidates.

    Only the top ``max(ks)`` rows per split and ranker survive the rank filter, which
    Spark applies before the shuffle.
    """
    tests = scored.select("cand_key", "label", F.explode("held_out").alias("split"), *[c.alias(f"r_{n}") for n, c in rankers.items()])
    out = None
    for name in rankers:
        order = Window.partitionBy("split").orderBy(F.col(f"r_{name}").desc(), "cand_key")
        top = tests.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ks))
        hits = top.groupBy("split").agg(
            *[F.avg(F.when(F.col("place") <= k, F.col("label"))).alias(f"k_{k}") for k in ks]
        )
        rows = hits.select(
            "split",
            F.lit(name).alias("ranker"),
            F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k_{k}").alias("precision")) for k in ks])).alias("x"),
        ).select("split", "ranker", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def heuristic_precision(training: DataFrame, ks=PRECISION_DEPTHS) -> DataFrame:
    return precision_at(training, {"heuristic": F.col("heuristic")}, ks)


def held_out_precision(scored: DataFrame, params: RankerParams, ks=PRECISION_DEPTHS) -> DataFrame:
    """Both rankers on each split's own test candidates, summarised over the splits."""
    models = F.array(*[F.col(f"p_{s}") for s in range(params.splits)])
    per_row = scored.select("cand_key", "label", "heuristic", F.explode("held_out").alias("split"), models.alias("ps"))
    own = per_row.select(
        "cand_key", "label", F.array("split").alias("held_out"), "heuristic", F.element_at("ps", F.col("split") + 1).alias("own")
    )
    runs = precision_at(own, {"heuristic": F.col("heuristic"), "learned": F.col("own")}, ks)
    wide = runs.groupBy("split", "k").agg(
        F.max(F.when(F.col("ranker") == "heuristic", F.col("precision"))).alias("heuristic"),
        F.max(F.when(F.col("ranker") == "learned", F.col("precision"))).alias("learned"),
    )
    return wide.groupBy("k").agg(
        *[x for r in ("heuristic", "learned")
          for x in (F.round(F.avg(r), 4).alias(f"{r}_mean"), F.round(F.stddev_pop(r), 4).alias(f"{r}_sd"))],
        F.count_if(F.col("learned") > F.col("heuristic")).alias("learned_wins"),
    )


def coverage_summary(training: DataFrame, splits: int) -> DataFrame:
    return training.agg(
        F.lit(splits).alias("splits"),
        F.count("*").alias("candidates"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_distinct(F.when(F.col("touched") >= 0, F.col("touched"))).alias("rings_covered"),
    )


def learned_queue(scored: DataFrame, rings: DataFrame, top_k: int, pool: int = 8) -> DataFrame:
    """The queue head reordered: the best ``top_k * pool`` rings by learned score.

    Candidates meet rings on the canonical account set; of several candidates on one set
    the last in detector order speaks for it.
    """
    head = rings.where(F.col("ring_id") <= top_k * pool).select("ring_id", "accounts")
    order = F.struct(kind_order(F.col("kind")), F.col("cand_key"))
    matched = (
        scored.join(head, "accounts")
        .groupBy("ring_id")
        .agg(F.round(F.max_by("learned", order), 5).alias("score"))
    )
    best = matched.orderBy(F.col("score").desc(), "ring_id").limit(top_k)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "ring_id"))
    return best.select(place.alias("place"), "ring_id", "score")


def average_precision(rows: DataFrame, scores: dict[str, str], name: str) -> dict[str, float]:
    """Area under the precision-recall curve of every score column, each precision weighted by its gain in recall.

    Rows of one score enter together. Per score only the number of rows and positives is
    kept, and running totals come from a range-partitioned order, so no task sees all scores.
    All columns go through the same few jobs.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).alias("s")) for k, c in scores.items()])
    per = rows.select("label", F.explode(entries).alias("e")).groupBy("e.key", "e.s").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("y")
    )
    order = [F.asc("key"), F.desc("s")]
    placed = stage(per.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_at", 33)
    totals = placed.groupBy("key", part.alias("part")).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per column and partition
    offsets = totals.select("key", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ny"])
    running = Window.partitionBy("key", "part").orderBy("_at")
    curve = placed.withColumn("part", part).join(F.broadcast(offsets), ["key", "part"])
    curve = curve.select("key", "y", *[(F.sum(c).over(running) + F.col(f"{c}0")).alias(f"{c}1") for c in "ny"])
    areas = curve.groupBy("key").agg((F.sum(F.col("y") * F.col("y1") / F.col("n1")) / F.sum("y")).alias("area")).collect()
    found = {r.key: r.area or 0.0 for r in areas}
    return {k: found.get(k, 0.0) for k in scores}


def permutation_importance(
    forest: boosting.Forest, rows: DataFrame, repeats: int = 3, top: int = 6, seed: int = 0, split: int = 0
) -> DataFrame:
    """Drop in area under precision-recall of a split's model when one feature's column is shuffled.

    Rows are numbered once in hash order; a repeat hands every row the feature values of
    the row a fixed distance further on, which is a permutation of the whole column. One
    self-join and one pass of the model per repeat serve all features.
    """
    spark = rows.sparkSession
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cand_key"))).asc(), F.col("cand_key").asc()]
    placed = stage(global_rank(rows.select("cand_key", "label", *FEATURES), order, "importance-order", "place"), "importance")
    n = placed.count()
    base = average_precision(stage(forest.score(placed, ["p"], [split]), "importance-base"), {"": "p"}, "importance-curve")[""]
    drops = {f: 0.0 for f in FEATURES}
    for r in range(repeats):
        shift = 1 + (n * (r + 1)) // (repeats + 1)
        donors = placed.select(
            (F.pmod(F.col("place") - 1 - shift, F.lit(n)) + 1).alias("place"),
            *[F.col(f).alias(f"d_{f}") for f in FEATURES],
        )
        mixed = forest.score_mixed(placed.join(donors, "place"), [f"d_{f}" for f in FEATURES], [f"p_{f}" for f in FEATURES], split)
        mixed = stage(mixed.select("label", *[f"p_{f}" for f in FEATURES]), "importance-scores")
        for f, value in average_precision(mixed, {f: f"p_{f}" for f in FEATURES}, "importance-curve").items():
            drops[f] += (base - value) / repeats
    ranked = sorted(drops.items(), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame(ranked, "feature string, importance double")
