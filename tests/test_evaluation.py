import random

import pytest
from pyspark.sql import functions as F

from flowtrail.operators import compare, graph, labels, ranker, rules, scoring
from flowtrail.schema import CANDIDATE
from flowtrail.session import stage


@pytest.fixture
def toy(transfers):
    """A loop of four, a pair of transfers into one account and a single transfer, beside
    laundering in no ring, clean payments and a self-payment."""
    loop, into, single = ({"ring": i, "bad": 1, "type": t} for i, t in ((7, "CYCLE"), (8, "GATHER-SCATTER"), (9, "STACK")))
    return transfers(
        [("k1", "k2", 40, 0, loop), ("k2", "k3", 38, 3, loop), ("k3", "k4", 35, 7, loop), ("k4", "k1", 33, 20, loop),
         ("u1", "v", 12, 1, into), ("u2", "v", 14, 2, into), ("f", "g", 90, 4, single),
         ("e1", "e2", 6, 5, {"bad": 1}), ("h1", "h2", 2, 0), ("h1", "h3", 2, 9), ("w", "w", 8, 1)]
    )


LOOP, INTO, SINGLE = ["k1", "k2", "k3", "k4"], ["u1", "u2", "v"], ["f", "g"]


def predict(spark, *rings):
    return spark.createDataFrame([(i + 1, a) for i, r in enumerate(rings) for a in r], "ring_id bigint, account string")


def metrics(spark, toy, *rings):
    predicted = predict(spark, *rings)
    sets = scoring.account_sets(predicted, scoring.account_truth(toy))
    acc = scoring.account_metrics(sets).head()
    per_ring = scoring.ring_metrics(predicted, scoring.ring_truth(toy), scoring.ring_accounts(toy))
    return acc, {r.ring_id: r for r in per_ring.collect()}


def test_truth_partitions(toy):
    truth = {r.ring_id: (r.transactions, r.bucket) for r in scoring.ring_truth(toy).collect()}
    assert {i: n for i, (n, _) in truth.items()} == {7: 4, 8: 2, 9: 1}
    assert truth[7][1] == "detectable" and truth[9][1] == "single_txn" and len({b for _, b in truth.values()}) == 3
    flags = {r.account: r.excused for r in scoring.account_truth(toy).collect()}
    assert {a for a, e in flags.items() if e} == {"e1", "e2"}


def test_oracle_excused_and_innocent(spark, toy):
    acc, per = metrics(spark, toy, LOOP, INTO, SINGLE)
    assert acc.recall == 1 and acc.precision_strict == 1 and all(r.detected for r in per.values())
    acc, _ = metrics(spark, toy, INTO, ["e2"])
    assert acc.precision_strict == pytest.approx(3 / 4) and acc.precision_lenient == 1
    acc, _ = metrics(spark, toy, [*INTO, "h1", "w"])
    assert acc.precision_lenient == pytest.approx(3 / 5) and acc.recall == pytest.approx(3 / 9)


def test_coverage_and_no_credit_for_splitting(spark, toy):
    _, per = metrics(spark, toy, ["k1", "k3"])
    assert per[7].detected and per[7].coverage == 0.5 and per[8].coverage == per[9].coverage == 0
    _, per = metrics(spark, toy, ["k4"], ["v"])
    assert not per[7].detected and not per[8].detected and per[8].coverage == pytest.approx(1 / 3)
    acc, per = metrics(spark, toy, *[[a] for a in LOOP])
    assert acc.recall == pytest.approx(4 / 9) and not per[7].detected


def test_shapes_keep_the_best_jaccard(spark, toy):
    _, per = metrics(spark, toy, ["u1", "v", "z1", "z2"], ["u1", "v", "z3"], ["u2", "z1"])
    assert per[8].jaccard == pytest.approx(2 / 4) and per[8].coverage == pytest.approx(2 / 3)


def test_no_predictions_and_no_labels(spark, toy, transfers):
    acc, per = metrics(spark, toy)
    assert (acc.flagged, acc.recall, acc.precision_strict, acc.f1_strict) == (0, 0, 0, 0)
    clean = transfers([("h1", "h2", 1, 0)])
    report = {r.metric: r.value for r in scoring.score_report(predict(spark, ["h1"]), clean).where("section <> 'by_bucket'").collect()}
    assert report["all_total"] == 0 and report["detectable_recall"] == 0


def test_calibration(toy):
    rows = {r.baseline: r for r in scoring.calibration(toy, graph.node_table(toy)).collect()}
    assert rows["oracle"].recall == rows["oracle"].precision_strict == 1 and rows["oracle"].detected_of_all == 3
    assert rows["flag_all"].recall == 1 and rows["flag_none"].flagged == 0


def test_depth_table_equals_scoring_each_head(spark, toy):
    rings = [["h2", "h3"], ["k1", "k2", "k3"], [*SINGLE, "e1"], ["u1"]]
    table = {r.k: r for r in scoring.depth_table(predict(spark, *rings), toy, (1, 2, 3, 4)).collect()}
    for k in (1, 2, 3, 4):
        acc, per = metrics(spark, toy, *rings[:k])
        assert table[k].precision == acc.precision_strict and table[k].recall == acc.recall
        assert table[k].rings_hit == sum(r.detected and r.bucket == "detectable" for r in per.values())


def test_rules_by_hand(transfers):
    many = [("B", f"p{i}", 1, 30) for i in range(11)]
    rows = [("A", "x", 3_000_000, 10), ("A", "y", 2_000_001, 12, {"bad": 1}), ("C", "z", 10, 1), ("C", "z", 10, 5),
            ("D", "z", 600_000, 40, {"cur": "Yen"}), ("E", "z", 5_000_000, 9)]
    df = transfers(many + rows)
    flags = {(r.from_node, r.to_node, r.timestamp.hour): r for r in rules.rule_flags(df).collect()}
    assert flags["A", "x", 10].high_daily_volume and not flags["E", "z", 9].high_daily_volume
    assert flags["C", "z", 1].overnight_activity and not flags["C", "z", 5].overnight_activity
    assert flags["B", "p0", 6].high_frequency and not flags["A", "x", 10].high_frequency
    assert flags["D", "z", 16].large_cross_border and flags["E", "z", 9].large_single_transaction
    profile = rules.rule_profile(df)
    per = {r.rule: (r.flags, r.laundering_caught) for r in rules.per_rule(profile).collect()}
    assert per["high_daily_volume"] == (2, 1) and per["high_frequency"] == (11, 0)
    total = rules.rule_evaluation(profile).head()
    assert (total.total_flags, total.laundering_caught, total.transactions_scanned) == (16, 1, 17)


def test_queue_depths_need_both_ends(spark, transfers):
    df = transfers([("A", "B", 1, 0, {"bad": 1}), ("A", "C", 1, 0), ("A", "Z", 1, 0), ("Q", "Q", 1, 0)])
    rings = spark.createDataFrame([(1, ["A", "B"]), (2, ["C", "Q"])], "ring_id bigint, accounts array<string>")
    depth = {(r.from_node, r.to_node): r.depth for r in compare.pair_depth(compare.pair_labels(df), rings).collect()}
    assert depth == {("A", "B"): 1, ("A", "C"): 2, ("A", "Z"): None, ("Q", "Q"): 2}
    rule_totals = rules.rule_evaluation(rules.rule_profile(df))
    table = {r.engine: r for r in compare.compare(compare.pair_depth(compare.pair_labels(df), rings), rule_totals, rings, (1, 9)).collect()}
    assert set(table) == {"top_1", "full_queue", "flag_everything", "rule_engine"}
    assert table["top_1"].precision == 1 and table["full_queue"].alerts_per_case == 3
    assert table["rule_engine"].alerts_per_case is None


def test_label_attach_is_lossless_and_keeps_first(spark, transfers):
    df = transfers([("A", "B", 0.034277, 0), ("A", "B", 1, 0), ("A", "B", 1, 0)])
    pats = transfers([("A", "B", 0.034277, 0, {"ring": 2, "type": "CYCLE"}), ("A", "B", 0.034277, 0, {"ring": 1, "type": "STACK"}),
                      ("Z", "B", 1, 0, {"ring": 3, "type": "STACK"})])
    pats = pats.withColumn("line", F.when(F.col("ring_id") == 2, 1).otherwise(F.col("ring_id") + 5))
    got = labels.attach_labels(df, pats)
    assert sorted((r.amount_paid, r.ring_id) for r in got.collect() if r.ring_id) == [(0.034277, 2)] and got.count() == 3
    row = labels.reconciliation(got, pats).head()
    assert (row.pattern_rows, row.pattern_keys, row.unmatched_pattern_keys, row.rows_assigned_to_a_ring) == (3, 2, 1, 1)


def test_held_out_rings_are_whole_and_exactly_thirty_percent(spark):
    touched = spark.range(200).select(F.col("id").cast("string").alias("cand_key"), (F.col("id") % 21 - 1).alias("touched"))
    table = ranker.split_table(touched, 4)
    for split in range(4):
        test = table.where(F.array_contains("held_out", split) & (F.col("touched") >= 0)).select("touched").distinct().count()
        train = table.where(~F.array_contains("held_out", split) & (F.col("touched") >= 0)).select("touched").distinct().count()
        assert test == 6 and train == 14


def test_ranker_learns_a_separable_toy_and_scores_every_candidate(spark):
    params = ranker.RankerParams(splits=2, iterations=5, bins=200)
    number = F.col("id").cast("double")
    rows = spark.range(120).select(
        F.col("id").cast("string").alias("cand_key"),
        *[(number if f == "score" else F.lit(None).cast("double") if f in ranker.NUMERIC[2:] else F.lit(1.0)).alias(f) for f in ranker.FEATURES],
        (F.col("id") >= 80).cast("double").alias("label"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(0))).when(F.col("id") % 3 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("held_out"),
        number.alias("heuristic"),
    )
    scored = ranker.train_and_score(rows, params)
    got = scored.collect()
    assert len(got) == 120 and all(0 <= p <= 1 for r in got for p in (r.p_0, r.p_1)) and "features" not in scored.columns
    assert min(r.learned for r in got if r.label) > max(r.learned for r in got if not r.label)
    table = {r.k: r for r in ranker.held_out_precision(scored, params, (5, 10)).collect()}
    assert table[5].learned_mean == table[10].learned_mean == 1 and table[10].learned_wins == 0
    model = ranker.fit(rows, params)
    best = ranker.permutation_importance(model, rows, repeats=1, top=2).collect()
    assert best[0].feature == "score" and best[0].importance > 0.1 and best[1].importance == 0


@pytest.mark.parametrize("share", [0.2, 0.3, 0.5, 0.75, 1.0])
def test_rings_reaching_are_those_of_all_pairs(spark, share):
    rng = random.Random(3)
    names = [f"a{i}" for i in range(25)]
    truth = {r: rng.sample(names, rng.randrange(1, 11)) for r in range(12)}
    sets = {p: [*rng.sample(names, rng.randrange(1, 9)), "hot"] for p in range(80)}
    truth[3] = ["hot", "a1"]
    made = lambda d: spark.createDataFrame([(k, a) for k, v in d.items() for a in v], "ring_id bigint, account string")
    for kind in ("coverage", "jaccard"):
        want = set()
        for r, t in truth.items():
            for p, m in sets.items():
                shared = len(set(t) & set(m))
                rate = shared / len(t) if kind == "coverage" else shared / len(set(t) | set(m))
                if shared and rate >= share - 1e-9:
                    want.add((r, p, shared))
        got = scoring.rings_reaching(made(sets).union(made({0: sets[0]})), made(truth), **{kind: share})
        assert sorted((x.ring_id, x.predicted_id, x.overlap) for x in got.collect()) == sorted(want)
    with pytest.raises(ValueError):
        scoring.rings_reaching(made(sets), made(truth))


def test_hot_account_is_not_joined_where_rarer_ones_decide(spark):
    truth = spark.createDataFrame([(1, a) for a in ("hot", "x", "y", "z")], "ring_id bigint, account string")
    sets = spark.range(500).select(F.col("id").alias("ring_id"), F.lit("hot").alias("account"))
    sets = sets.union(spark.createDataFrame([(7, "x"), (7, "y"), (8, "z")], "ring_id bigint, account string"))
    got = scoring.rings_reaching(sets, truth, coverage=0.5)
    assert [(r.predicted_id, r.overlap) for r in got.orderBy("predicted_id").collect()] == [(7, 3), (8, 2)]


def test_pairs_that_cannot_get_there_are_not_looked_up_again(spark, monkeypatch):
    made = lambda d: spark.createDataFrame([(k, a) for k, v in d.items() for a in v], "ring_id bigint, account string")
    kept = {}
    monkeypatch.setattr(scoring, "stage", lambda df, name: kept.setdefault(name, df))
    truth = {1: "abcdef"}
    sets = {1: "abcdef", 2: "abcdeg", 3: "ahijkl", 4: "abhijk", 5: "f", 6: "abcf"}
    got = scoring.rings_reaching(made(sets), made(truth), jaccard=0.6)
    assert sorted((r.predicted_id, r.overlap) for r in got.collect()) == [(1, 6), (2, 5), (6, 4)]
    # The others share too few accounts even if they held all those not yet looked up.
    assert {r.predicted_id for r in kept["ring-candidates"].collect()} == {1, 2, 6}
    kept.clear()
    met = scoring.rings_reaching(made(sets), made(truth), coverage=0.1)
    assert sorted((r.predicted_id, r.overlap) for r in met.collect()) == [(1, 6), (2, 5), (3, 1), (4, 2), (5, 1), (6, 4)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("share", [{"coverage": 0.5}, {"jaccard": 0.2}])
def test_rings_reaching_broadcasts_no_table_that_grows(spark, toy, share):
    found = scoring.rings_reaching(predict(spark, LOOP, INTO), scoring.ring_accounts(toy), **share)
    assert "Broadcast" not in plan_of(found) and {(r.ring_id, r.predicted_id) for r in found.collect()} == {(7, 1), (8, 2)}


def test_scoring_rings_broadcasts_no_table_that_grows(spark, toy):
    per_ring = scoring.ring_metrics(predict(spark, LOOP), scoring.ring_truth(toy), scoring.ring_accounts(toy))
    assert "Broadcast" not in plan_of(per_ring)


def test_labels_and_splits_are_written_before_features_meet_them(spark, monkeypatch):
    rows = [(["A", "B"], "cycle", 0.4, None), (["C"], "velocity_burst", 0.5, None), (["B", "D"], "fan_in", 0.6, None)]
    candidates = spark.createDataFrame(rows, CANDIDATE)
    truth = spark.createDataFrame([(7, "B"), (3, "B"), (9, "D")], "ring_id bigint, account string")
    touched = ranker.touched_ring(candidates, truth)
    # Keys are shuffled as the bytes that their digits stand for.
    assert "unhex" in plan_of(touched)
    keys = {r.kind: r.cand_key for r in candidates.select("kind", ranker.candidate_key().alias("cand_key")).collect()}
    assert dict(touched.collect()) == {keys["cycle"]: 3, keys["velocity_burst"]: -1, keys["fan_in"]: 3}
    written = []
    monkeypatch.setattr(ranker, "stage", lambda df, name: written.append(name) or stage(df, name))
    table = ranker.training_table(candidates, truth, 2)
    assert written == ["splits"] and "evidence" not in table.columns
    assert {r.kind: r.label for r in table.collect()} == {"cycle": 1.0, "velocity_burst": 0.0, "fan_in": 1.0}
