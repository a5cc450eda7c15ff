import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtrail.functions import skew
from flowtrail.operators import queue
from flowtrail.plans.detect import Detection
from flowtrail.plans.evaluate import CaseBook, Evaluation
from flowtrail.schema import CANDIDATE


@pytest.fixture
def candidates(spark):
    def build(rows):
        blank = dict.fromkeys(CANDIDATE["evidence"].dataType.names)
        return spark.createDataFrame(
            [(sorted(a), k, float(s), {**blank, "node": sorted(a)[0]}) for a, k, s in rows], CANDIDATE
        )

    return build


def rings(df):
    return queue.combine(df).orderBy("ring_id").collect()


def test_shared_hub_does_not_merge_rings(candidates):
    got = rings(candidates([("HAB", "fan_out", 0.5), ("HCD", "fan_out", 0.4)]))
    assert [r.account_count for r in got] == [3, 3]


def test_oversized_candidate_dropped_but_still_corroborates(candidates, spark):
    big = [f"x{i:02d}" for i in range(61)]
    got = rings(candidates([(big, "fan_in", 0.9), (["x00", "y"], "cycle", 0.4)]))
    assert len(got) == 1 and got[0].signals == ["cycle", "fan_in"]


def test_identical_sets_collapse(candidates):
    got = rings(candidates([("AB", "cycle", 0.4), ("AB", "pass_through", 0.9)]))
    assert len(got) == 1 and got[0].signals == ["cycle", "pass_through"]
    assert [e.kind for e in got[0].evidence] == ["pass_through", "cycle"]
    assert got[0].score == pytest.approx(0.088 * 0.9)


def test_prior_orders_equal_scores_and_ids_follow_rank(candidates):
    got = rings(candidates([("A", "velocity_burst", 0.8), ("BCD", "pass_through", 0.8)]))
    assert [r.accounts for r in got] == [["B", "C", "D"], ["A"]]
    got = rings(candidates([("AB", "cycle", 0.1), ("CDE", "pass_through", 0.9)]))
    assert [r.ring_id for r in got] == [1, 2] and got[0].score > got[1].score


def test_top_selection_equals_head_of_queue(candidates):
    rng = random.Random(1)
    kinds = ["fan_out", "fan_in", "pass_through", "velocity_burst", "cycle"]
    rows = [(rng.sample("ABCDEFGHIJKL", 3), rng.choice(kinds), rng.choice([0.2, 0.4, 0.8])) for _ in range(80)]
    df = candidates(rows)
    cols = ["ring_id", "accounts", "signals", "score"]
    whole = queue.combine(df).where("ring_id <= 10").select(*cols).orderBy("ring_id").collect()
    assert whole == queue.top_rings(df, 10).select(*cols).orderBy("ring_id").collect()


def test_ranked_and_head_equal_the_whole_queue(candidates):
    rng = random.Random(3)
    kinds = ["fan_out", "fan_in", "pass_through", "velocity_burst", "cycle"]
    rows = [(rng.sample("ABCDEFGHIJKL", 3), rng.choice(kinds), rng.choice([0.2, 0.4, 0.8])) for _ in range(80)]
    df = candidates([*rows, ([f"x{i:02d}" for i in range(61)] + ["A"], "fan_in", 0.9)])
    order = queue.ranked(df)
    whole = queue.combine(df).orderBy("ring_id").collect()
    assert order.orderBy("ring_id").collect() == [r[:3] for r in whole]
    assert order.columns == ["ring_id", "score", "accounts"]
    assert queue.head(order, df, 10).orderBy("ring_id").collect() == whole[:10]


def test_ranks_depths_and_top_rings_need_no_evidence_of_the_whole_queue(transfers):
    run = Detection(transfers([("A", "B", 100, 0), ("B", "C", 98, 2), ("C", "A", 97, 5), ("C", "D", 5, 9)]))
    assert Evaluation(run).depths.where("depth is not null").count() == 3
    assert Evaluation(run).predicted.count() > 0
    assert CaseBook(run).roles.count() > 0
    assert "rings" not in run.__dict__


def test_global_rank_equals_row_number_with_ties(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randrange(4), i) for i in range(500)], "s int, i int").repartition(9)
    order = [F.col("s").desc(), F.col("i").asc()]
    got = queue.global_rank(df, order, "t", "rank")
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    key = lambda d: sorted((r.i, r["rank"]) for r in d.collect())
    assert key(got) == key(want)


@pytest.mark.parametrize("present", [True, False])
def test_attach_spreads_a_heavy_key(spark, monkeypatch, present):
    """Four fifths of the rows on one key, in the lookup or not: values of a plain join, even partitions."""
    monkeypatch.setattr(skew, "LIGHT_ROWS", 500)
    monkeypatch.setattr(skew, "SKETCH_KEYS", 10)
    key = F.when(F.col("id") % 5 != 0, F.lit(-1)).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 1700)
    df = spark.range(20_000, numPartitions=16).select(key.alias("k"), F.col("id").alias("v"))
    lookup = spark.range(-1 if present else 0, 1200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = skew.attach(df, lookup, ("k", "k"), {"x": "x"})
        sizes = got.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        want = df.join(lookup, "k", "left").select("k", "v", "x")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        for c, value in old.items():
            spark.conf.unset(c) if value is None else spark.conf.set(c, value)
    assert sizes.max() <= 1.2 * 20_000 / 16
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_attach_reads_its_rows_twice_and_a_chain_once_each(spark, tmp_path):
    spark.range(5000).select((F.col("id") % 70).alias("a"), (F.col("id") % 90).alias("b")).write.parquet(f"{tmp_path}/rows")
    spark.range(80).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x")).write.parquet(f"{tmp_path}/lookup")
    rows, lookup = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("rows", "lookup"))
    scans = lambda d, name: sum(f"{tmp_path}/{name}" in x and "FileScan" in x for x in d._jdf.queryExecution().executedPlan().toString().split("\n"))
    one = skew.attach(rows, lookup, ("a", "k"), {"x": "xa"})
    assert scans(one, "rows") == 2
    two = skew.attach(one, lookup, ("b", "k"), {"x": "xb"}, keys_from=rows)
    assert scans(two, "rows") == 3  # a sketch for each join, and the rows
    assert two.where("not (xa <=> if(a < 80, a * 2, null)) or not (xb <=> if(b < 80, b * 2, null))").count() == 0 and two.count() == 5000


def test_frequent_keys_are_found_and_rare_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT_ROWS", 1)
    monkeypatch.setattr(skew, "SKETCH_KEYS", 100)
    monkeypatch.setattr(skew, "SKETCH_ITEMS", 1024)
    key = F.when(F.col("id") % 10 < 3, F.lit("third")).when(F.col("id") % 50 == 7, F.lit("fiftieth")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    keys = spark.range(40_000, numPartitions=9).select(key.alias("k"))
    got = {r[0] for r in skew.frequent_hashes(keys, "k").collect()}
    assert got == {r[0] for r in spark.createDataFrame([("third",), ("fiftieth",)], "k string").select(F.xxhash64("k")).collect()}
    assert skew.frequent_hashes(keys.limit(0), "k").count() == 0


def test_drop_heavy_only_removes_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LIGHT_ROWS", 5)
    monkeypatch.setattr(skew, "MAX_HEAVY_KEYS", 4)
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i}", i) for i in range(10)], "k string, v int")
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    left = skew.drop_heavy(df, "k", counts, "k", "n", 10)
    assert skew.drop_heavy(df, "k", counts, "k", "n", 60).count() == 60
    assert left.where("k = 'hot'").count() == 0 and left.count() == 10
