"""Score predicted rings against labelled ones.

Predictions are long tables ``ring_id, account``: a prediction that flags everything is
then just many rows, not one giant array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.functions.columns import beside, ratio_or_zero
from flowtrail.functions.skew import shuffled
from flowtrail.params import DETECTABLE_MIN_TRANSFERS, PRECISION_DEPTHS, RING_COVERAGE
from flowtrail.session import stage


def memberships(rings: DataFrame) -> DataFrame:
    return rings.select("ring_id", F.explode("accounts").alias("account"))


def size_bucket(transactions: Column) -> Column:
    return (
        F.when(transactions == 1, "single_txn")
        .when(transactions < DETECTABLE_MIN_TRANSFERS, "round_trip")
        .otherwise("detectable")
    )


def ring_truth(labelled: DataFrame) -> DataFrame:
    """One row per labelled ring."""
    return (
        labelled.where(F.col("ring_id").isNotNull())
        .groupBy("ring_id")
        .agg(F.min("pattern_type").alias("pattern_type"), F.count("*").alias("transactions"))
        .withColumn("bucket", size_bucket(F.col("transactions")))
    )


def ring_accounts(labelled: DataFrame) -> DataFrame:
    return (
        labelled.where(F.col("ring_id").isNotNull())
        .select("ring_id", F.explode(F.array("from_node", "to_node")).alias("account"))
        .distinct()
    )


def account_truth(labelled: DataFrame) -> DataFrame:
    """Accounts of labelled rings, and accounts excused by laundering no ring claims."""
    has_ring = F.col("ring_id").isNotNull()
    loose = (F.col("is_laundering") == 1) & ~has_ring
    ends = labelled.where(has_ring | loose).select(
        F.explode(F.array("from_node", "to_node")).alias("account"), has_ring.alias("r"), loose.alias("l")
    )
    return (
        ends.groupBy("account")
        .agg(F.max("r").alias("in_ring"), F.max("l").alias("loose"))
        .select("account", "in_ring", (F.col("loose") & ~F.col("in_ring")).alias("excused"))
    )


def account_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Each account's best predicted rank beside its truth flags; NULL rank: not flagged."""
    ranks = predicted.groupBy("account").agg(F.min("ring_id").alias("rank"))
    return ranks.join(shuffled(truth), "account", "full").select(
        "account",
        "rank",
        F.coalesce("in_ring", F.lit(False)).alias("in_ring"),
        F.coalesce("excused", F.lit(False)).alias("excused"),
    )


def account_metrics(sets: DataFrame, depths: tuple[int, ...] = ()) -> DataFrame:
    """Account-level counts and rates for the whole prediction (depth NULL) and each depth."""
    cuts = [(None, F.col("rank").isNotNull())] + [(d, F.coalesce(F.col("rank") <= d, F.lit(False))) for d in depths]

    def counts(i, cut):
        hit = cut & F.col("in_ring")
        return [
            F.count_if(cut).alias(f"flagged_{i}"),
            F.count_if(hit).alias(f"tp_{i}"),
            F.count_if(cut & F.col("excused")).alias(f"ex_{i}"),
        ]

    one = sets.agg(
        F.count_if("in_ring").alias("truth"), *[c for i, (_, cut) in enumerate(cuts) for c in counts(i, cut)]
    )
    rows = one.select(
        "truth",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(d).cast("bigint").alias("depth"),
                        F.col(f"flagged_{i}").alias("flagged"),
                        F.col(f"tp_{i}").alias("true_positives"),
                        F.col(f"ex_{i}").alias("excused_false_positives"),
                    )
                    for i, (d, _) in enumerate(cuts)
                ]
            )
        ).alias("m"),
    ).select("truth", "m.*")
    tp, flagged = F.col("true_positives"), F.col("flagged")
    rated = (
        rows.withColumn("false_positives", flagged - tp)
        .withColumn("recall", ratio_or_zero(tp, F.col("truth")))
        .withColumn("precision_strict", ratio_or_zero(tp, flagged))
        .withColumn("precision_lenient", ratio_or_zero(tp, flagged - F.col("excused_false_positives")))
    )
    p, r = F.col("precision_strict"), F.col("recall")
    return rated.withColumn("f1_strict", ratio_or_zero(p * r * 2, p + r)).drop("truth")


def ring_overlaps(predicted: DataFrame, truth_accounts: DataFrame) -> DataFrame:
    """Every true ring with every predicted ring sharing an account, and how many they share."""
    return (
        predicted.select(F.col("ring_id").alias("predicted_id"), "account")
        .join(shuffled(truth_accounts), "account")
        .groupBy("ring_id", "predicted_id")
        .agg(F.count("*").alias("overlap"))
    )


def rings_reaching(
    predicted: DataFrame, truth_accounts: DataFrame, coverage: float | None = None, jaccard: float | None = None
) -> DataFrame:
    """``ring_id, predicted_id, overlap, coverage, jaccard`` of the pairs that reach ``coverage`` or ``jaccard``, one of them given.

    A set-similarity join with a prefix filter. Accounts are ordered from the rarest among
    predictions to the commonest. A prediction that holds at least t of a ring's n accounts
    holds one of its n - t + 1 rarest, and only those are joined, so an account in very many
    predictions is left out wherever a ring has rarer ones. Accounts shared among those are counted as they are
    met, and only the t - 1 others of a ring are then looked for in the predictions that can still get there.
    A Jaccard index of j asks for t >= j n, and also that sizes differ by no more than 1 / j.
    """
    if (coverage is None) == (jaccard is None):
        raise ValueError("give one of coverage and jaccard")
    least = coverage if jaccard is None else jaccard
    held = predicted.select(F.col("ring_id").alias("predicted_id"), "account")
    truth = truth_accounts.where(F.col("ring_id").isNotNull()).select("ring_id", "account").distinct()
    # Accounts of no labelled ring count for a prediction's size only.
    sets = stage(held.join(shuffled(truth.select("account").distinct()), "account", "left_semi").distinct(), "labelled-members")
    common = sets.groupBy("account").agg(F.count("*").alias("held_by"))
    rings = truth.join(shuffled(common), "account", "left").groupBy("ring_id").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("held_by", F.lit(0)).alias("held_by"), "account"))).alias("by_rarity")
    )
    n = F.size("by_rarity")
    # Rounded, so that a share such as 0.3 of 10 asks for 3 and not for 4.
    need = F.greatest(F.lit(1), F.ceil(F.round(n * F.lit(least), 9)).cast("int"))
    rings = rings.select("ring_id", F.col("by_rarity.account").alias("accounts"), n.alias("members"), need.alias("need"))
    rare = F.slice("accounts", F.lit(1), F.col("members") - F.col("need") + 1)
    rest = F.slice("accounts", F.col("members") - F.col("need") + 2, F.col("members"))
    prefixes = rings.select("ring_id", "members", "need", F.explode(rare).alias("account"))
    suffixes = rings.select("ring_id", F.explode(rest).alias("account"))
    # Dealt by prediction once, for both the distinct accounts and their number.
    sizes = held.repartition("predicted_id").distinct().groupBy("predicted_id").agg(F.count("*").alias("size"))
    met = prefixes.join(shuffled(sets), "account").groupBy("ring_id", "predicted_id", "members", "need").agg(F.count("*").alias("met"))
    found = met.join(shuffled(sizes), "predicted_id")
    if jaccard is not None:
        found = found.where(F.least("members", "size") >= F.lit(jaccard) * F.greatest("members", "size") - 1e-9)
        most = F.col("met") + F.col("need") - 1
        found = found.where(most >= F.lit(jaccard) * (F.col("members") + F.col("size") - most) - 1e-9)
    found = stage(found, "ring-candidates")
    others = (
        found.where(F.col("need") > 1).select("ring_id", "predicted_id").join(shuffled(suffixes), "ring_id")
        .join(shuffled(sets), ["predicted_id", "account"]).groupBy("ring_id", "predicted_id").agg(F.count("*").alias("others"))
    )
    counted = found.join(shuffled(others), ["ring_id", "predicted_id"], "left").select(
        "ring_id", "predicted_id", "members", "size", (F.col("met") + F.coalesce("others", F.lit(0))).alias("overlap")
    )
    rated = counted.select(
        "ring_id", "predicted_id", "overlap", (F.col("overlap") / F.col("members")).alias("coverage"),
        (F.col("overlap") / (F.col("members") + F.col("size") - F.col("overlap"))).alias("jaccard"),
    )
    return rated.where(F.col("coverage" if jaccard is None else "jaccard") >= F.lit(least) - 1e-9)


def distinct_shapes(predicted: DataFrame, truth_accounts: DataFrame) -> DataFrame:
    """Predictions reduced to what can matter for the best overlap.

    Coverage and Jaccard depend on a prediction only through the labelled accounts it
    holds and its size. Among predictions holding the same labelled accounts the smallest
    dominates, so one of them is kept. This is exact, and it is what keeps an account
    that sits in very many predictions from being paired with every true ring each time.
    """
    known = truth_accounts.select("account", F.lit(True).alias("known")).distinct()
    marked = predicted.join(shuffled(known), "account", "left")
    hit = F.when(F.col("known"), F.col("account"))
    kept = (
        marked.groupBy("ring_id")
        .agg(
            F.bit_xor(F.when(hit.isNotNull(), F.xxhash64("account"))).alias("a"),
            F.bit_xor(F.when(hit.isNotNull(), F.xxhash64(F.lit("b"), "account"))).alias("b"),
            F.count(hit).alias("hits"),
            F.count("*").alias("size"),
        )
        .where(F.col("hits") > 0)
        .groupBy("a", "b", "hits")
        .agg(F.min(F.struct("size", "ring_id")).alias("k"))
        .select("k.ring_id", "k.size")
    )
    return marked.where("known").join(shuffled(kept), "ring_id").select("ring_id", "size", "account")


def ring_metrics(
    predicted: DataFrame, truth: DataFrame, truth_accounts: DataFrame, coverage: float = RING_COVERAGE
) -> DataFrame:
    """Per labelled ring: best coverage, best Jaccard, detected. Misses score zero."""
    shapes = distinct_shapes(predicted, truth_accounts).select(
        F.col("ring_id").alias("predicted_id"), "size", "account"
    )
    overlap = (
        shapes.join(shuffled(truth_accounts), "account")
        .groupBy("ring_id", "predicted_id")
        .agg(F.count("*").alias("overlap"), F.max("size").alias("size"))
    )
    members = truth_accounts.groupBy("ring_id").agg(F.count("*").alias("members"))
    best = (
        overlap.join(shuffled(members), "ring_id")
        .groupBy("ring_id")
        .agg(
            F.max(F.col("overlap") / F.col("members")).alias("coverage"),
            F.max(F.col("overlap") / (F.col("members") + F.col("size") - F.col("overlap"))).alias("jaccard"),
        )
    )
    return truth.join(shuffled(best), "ring_id", "left").select(
        "ring_id",
        "pattern_type",
        "bucket",
        "transactions",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"),
        F.coalesce(F.col("coverage") >= coverage, F.lit(False)).alias("detected"),
    )


def ring_totals(per_ring: DataFrame) -> DataFrame:
    detectable = F.col("bucket") == "detectable"
    found = per_ring.agg(
        F.count_if(detectable & F.col("detected")).alias("detected_of_detectable"),
        F.count_if(detectable).alias("detectable_total"),
        F.count_if("detected").alias("detected_of_all"),
        F.count("*").alias("all_total"),
    )
    return found.withColumn(
        "detectable_recall", ratio_or_zero(F.col("detected_of_detectable"), F.col("detectable_total"))
    ).withColumn("all_recall", ratio_or_zero(F.col("detected_of_all"), F.col("all_total")))


def by_bucket(per_ring: DataFrame) -> DataFrame:
    return per_ring.groupBy("bucket").agg(
        F.count_if("detected").alias("detected"), F.count("*").alias("rings")
    )


def by_pattern(per_ring: DataFrame) -> DataFrame:
    return (
        per_ring.where(F.col("bucket") == "detectable")
        .groupBy("pattern_type")
        .agg(F.count_if("detected").alias("detected"), F.count("*").alias("rings"))
    )


def first_detecting_rank(
    predicted: DataFrame, truth_accounts: DataFrame, coverage: float = RING_COVERAGE
) -> DataFrame:
    """The rank of the first prediction that covers enough of each labelled ring."""
    members = truth_accounts.groupBy("ring_id").agg(F.count("*").alias("members"))
    return (
        ring_overlaps(predicted, truth_accounts)
        .join(shuffled(members), "ring_id")
        .where(F.col("overlap") / F.col("members") >= coverage)
        .groupBy("ring_id")
        .agg(F.min("predicted_id").alias("first_rank"))
    )


def depth_table(
    predicted: DataFrame,
    labelled: DataFrame,
    depths: tuple[int, ...] = PRECISION_DEPTHS,
    coverage: float = RING_COVERAGE,
) -> DataFrame:
    """Precision and recall of the head of the queue at each depth, from one pass each."""
    head = predicted.where(F.col("ring_id") <= max(depths))
    accounts = account_metrics(account_sets(head, account_truth(labelled)), depths).where(F.col("depth").isNotNull())
    rings = ring_truth(labelled).join(
        first_detecting_rank(head, ring_accounts(labelled), coverage), "ring_id", "left"
    )
    detectable = F.col("bucket") == "detectable"
    counts = rings.agg(
        F.count_if(detectable).alias("detectable_total"),
        *[F.count_if(detectable & (F.col("first_rank") <= d)).alias(f"d_{d}") for d in depths],
    )
    found = counts.select(
        "detectable_total",
        F.explode(
            F.array(*[F.struct(F.lit(d).cast("bigint").alias("k"), F.col(f"d_{d}").alias("rings_hit")) for d in depths])
        ).alias("x"),
    ).select("detectable_total", "x.*")
    return accounts.join(found, F.col("depth") == F.col("k")).select(
        "k",
        F.col("precision_strict").alias("precision"),
        "recall",
        "rings_hit",
        "detectable_total",
        F.col("true_positives").alias("accounts_hit"),
    )


def score_report(predicted: DataFrame, labelled: DataFrame, coverage: float = RING_COVERAGE) -> DataFrame:
    """The whole scoring result in long form: ``section, metric, value``."""
    per_ring = ring_metrics(predicted, ring_truth(labelled), ring_accounts(labelled), coverage)
    accounts = account_metrics(account_sets(predicted, account_truth(labelled))).drop("depth")
    rings = beside(ring_totals(per_ring), predicted.agg(F.count_distinct("ring_id").alias("predicted")))

    def long(df: DataFrame, section: str) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
        )
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")

    def grouped(df: DataFrame, key: str, section: str) -> DataFrame:
        pairs = F.array(
            *[
                F.struct(F.concat_ws(".", F.col(key), F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value"))
                for c in ("detected", "rings")
            ]
        )
        return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")

    return (
        long(accounts, "accounts")
        .unionByName(long(rings, "rings"))
        .unionByName(grouped(by_bucket(per_ring), "bucket", "by_bucket"))
        .unionByName(grouped(by_pattern(per_ring), "pattern_type", "by_pattern"))
    )


def calibration(labelled: DataFrame, all_accounts: DataFrame, coverage: float = RING_COVERAGE) -> DataFrame:
    """Oracle, flag-all and flag-none predictions through the scorer, one row each."""
    truth, members = ring_truth(labelled), ring_accounts(labelled)
    flags = account_truth(labelled)
    baselines = {
        "oracle": members,
        "flag_all": all_accounts.select(F.lit(1).cast("bigint").alias("ring_id"), F.col("node").alias("account")),
        "flag_none": members.where(F.lit(False)),
    }
    out = None
    for name, predicted in baselines.items():
        accounts = account_metrics(account_sets(predicted, flags)).drop("depth")
        rings = ring_totals(ring_metrics(predicted, truth, members, coverage))
        row = beside(accounts, rings).withColumn("baseline", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def calibration_verdict(rows: DataFrame) -> DataFrame:
    """``baseline, passed``: whether the scorer gives the baselines what they must get.

    The oracle has full recall, full precision and every ring; flagging every account has
    full recall, flagging none has none.
    """
    full = lambda c: F.abs(F.col(c) - 1) < 1e-9
    oracle = full("recall") & full("precision_strict") & (F.col("detected_of_all") == F.col("all_total"))
    verdict = (
        F.when(F.col("baseline") == "oracle", oracle)
        .when(F.col("baseline") == "flag_all", full("recall"))
        .otherwise((F.col("true_positives") == 0) & (F.col("detected_of_all") == 0))
    )
    return rows.select("baseline", F.coalesce(verdict, F.lit(False)).alias("passed"))
