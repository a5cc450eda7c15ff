import time

import pytest
from pyspark.sql import functions as F

from flowtrail.operators import labels
from flowtrail.session import build_session, shared_dir, stage
from flowtrail.sources import ring_log, tables, transfer_csv

HEAD = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
ROW = "2022/09/01 02:38,{0},A1,0110,B1,10154.74,Euro,10154.74,Euro,ACH,1"


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(HEAD + "\n" + ROW.format("011") + "\n" + ROW.format("0110").replace("10154.74", "0.034277") + "\n")
    rows = transfer_csv.read_transfers(spark, str(path)).orderBy("from_node").collect()
    assert [r.from_node for r in rows] == ["011-A1", "0110-A1"] and rows[1].amount_paid == 0.034277
    assert rows[0].timestamp.minute == 38 and rows[0].is_laundering == 1


def log(tmp_path, *lines):
    path = tmp_path / "log.txt"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


B, E = "BEGIN LAUNDERING ATTEMPT - ", "END LAUNDERING ATTEMPT - "


def test_ring_log(spark, tmp_path):
    path = log(tmp_path, B + "FAN-IN:  Max 3-degree Fan-In", ROW.format("1"), "", ROW.format("2"), E + "FAN-IN", "  ", B + "STACK", ROW.format("3"), E + "STACK")
    rows = ring_log.parse_ring_log(spark, path).orderBy("line").collect()
    assert [(r.ring_id, r.pattern_type, r.pattern_detail, r.from_bank) for r in rows] == [
        (1, "FAN-IN", "Max 3-degree Fan-In", "1"), (1, "FAN-IN", "Max 3-degree Fan-In", "2"), (2, "STACK", "", "3")]


@pytest.mark.parametrize(
    "lines, faults",
    [
        ([B + "STACK", B + "CYCLE", E + "CYCLE"], [(2, "nested_begin")]),
        ([E + "CYCLE"], [(1, "end_without_begin")]),
        ([B + "STACK", E + "CYCLE"], [(2, "end_type_mismatch")]),
        ([B + "STACK", E + "STACK", ROW.format("1")], [(3, "row_outside_block")]),
        ([ROW.format("1"), B + "STACK", E + "STACK"], [(1, "row_outside_block")]),
        ([B + "STACK", ROW.format("1")], [(1, "unclosed_block")]),
    ],
)
def test_ring_log_faults(spark, tmp_path, lines, faults):
    path = log(tmp_path, *lines)
    found = ring_log.violations(ring_log.numbered_lines(spark, path)).collect()
    assert [(r.line, r.rule) for r in found] == faults
    with pytest.raises(ValueError):
        ring_log.parse_ring_log(spark, path)


def test_ring_log_over_many_splits(spark, tmp_path):
    lines = []
    for i in range(60):
        lines += [B + "CYCLE:  ring %d" % i] + [ROW.format(str(i))] * (i % 4 + 1) + [E + "CYCLE"]
    path = log(tmp_path, *lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 4
        rows = ring_log.parse_ring_log(spark, path).select("ring_id", "from_bank", "pattern_detail", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(r.from_bank == str(r.ring_id - 1) and r.pattern_detail == f"ring {r.ring_id - 1}" for r in rows)
    assert sorted(r.line for r in rows) == [n for n, t in enumerate(lines, 1) if t[0] == "2"]


def test_cache_is_kept_unless_forced(spark, transfers, tmp_path):
    df = transfers([("A", "B", 1, 0, {"ring": 1, "type": "CYCLE"})])
    pats = df.withColumn("pattern_detail", F.lit("")).withColumn("line", F.lit(1))
    folder = str(tmp_path / "cache")
    tables.write_labelled_cache(df, pats, folder)
    tables.write_labelled_cache(df.union(df), pats, folder)
    assert tables.read_labelled_cache(spark, folder).count() == 1
    tables.write_labelled_cache(df.union(df), pats, folder, force=True)
    assert tables.read_labelled_cache(spark, folder).count() == 2
    assert tables.read_table(spark, folder, tables.ACCOUNT_LABELS).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_labelled_cache(spark, str(tmp_path / "absent"))


def test_queue_lookup(spark, tmp_path):
    rings = spark.createDataFrame([(2, 0.1, ["A"]), (1, 0.2, ["B"])], "ring_id bigint, score double, accounts array<string>")
    tables.write_queue(rings, str(tmp_path))
    assert tables.find_ring(tables.read_queue(spark, str(tmp_path)), 1).head().accounts == ["B"]
    assert tables.find_ring(tables.read_queue(spark, str(tmp_path)), 7).count() == 0


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(build_session())


def test_a_writer_that_stops_half_way_leaves_no_cache(spark, transfers, tmp_path):
    folder = str(tmp_path / "cache")
    df = transfers([("A", "B", 1, 0, {"ring": 1, "type": "CYCLE"})])

    def stop(path):
        df.write.parquet(path)
        raise RuntimeError("lost")

    first = {"a": lambda p: df.write.parquet(p), "b": stop}
    with pytest.raises(RuntimeError):
        tables.write_snapshot(spark, folder, first)
    assert tables.current_version(spark, folder) is None
    # What is left behind is not taken for a cache, so an unforced write does its work.
    whole = {"a": lambda p: df.write.parquet(p), "b": lambda p: df.union(df).write.parquet(p)}
    assert tables.write_snapshot(spark, folder, whole) and not tables.write_snapshot(spark, folder, whole)
    held = tables.read_table(spark, folder, "b")
    assert held.count() == 2
    # A forced write that fails leaves readers with the version they had.
    with pytest.raises(RuntimeError):
        tables.write_snapshot(spark, folder, first, force=True)
    assert tables.read_table(spark, folder, "b").count() == 2
    assert tables.write_snapshot(spark, folder, {"a": whole["a"], "b": whole["a"]}, force=True)
    assert tables.read_table(spark, folder, "b").count() == 1 and held.count() == 2
    assert len(tables.sweep(spark, folder)) == 3 and tables.read_table(spark, folder, "b").count() == 1


def test_gate_refuses_a_log_that_does_not_match(spark, transfers):
    log = transfers([("A", "B", 1, 0, {"ring": 1, "type": "CYCLE"}), ("A", "C", 9, 0, {"ring": 2, "type": "CYCLE"})]).withColumn("line", F.col("ring_id"))
    fine = labels.reconciliation(labels.attach_labels(transfers([("A", "B", 1, 0), ("A", "C", 9, 0)]), log), log)
    bad = labels.reconciliation(labels.attach_labels(transfers([("A", "B", 1, 0)]), log), log)
    assert labels.gate(fine).head().passed and not labels.gate(bad).head().passed
    assert labels.require_matched(fine).head().pattern_keys == 2
    with pytest.raises(ValueError, match="1 of 2"):
        labels.require_matched(bad)


def test_a_partitioned_table_is_written_without_sorting_a_task(spark):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    rows = spark.range(100).selectExpr("id", "cast(id % 4 as string) AS rail")
    back = stage(rows, "rails", partition_by=("rail",))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    writes = [p for i in range(plans.size()) if "InsertIntoHadoopFsRelationCommand" in (p := plans.apply(i).physicalPlanDescription()) and "/rails-" in p]
    assert writes and "Sort" not in writes[-1]
    assert spark.conf.get(key) == before and sorted(back.select("id", "rail").collect()) == sorted(rows.collect())


def test_what_a_staged_table_was_shuffled_for_does_not_stay(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    for adaptive in ("false", "true"):
        before, old = shuffled(), (spark.conf.get(key, None), spark.conf.get("spark.sql.adaptive.enabled"))
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            back = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sevenths")
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", old[1])
        until = time.time() + 10
        while shuffled() - before and time.time() < until:
            time.sleep(0.1)
        assert not shuffled() - before
        assert back.count() == 7 and spark.conf.get(key, None) == old[0]
        assert all(".zstd." in f for f in back.inputFiles())


def test_transfers_are_exploded_by_name_and_their_parts_follow(spark):
    from flowtrail.sources.commerce import derive_transfers, with_parts

    rows = derive_transfers(spark, "/root/testdata/sf0.001")
    # A filter over an array of whole transfers is interpreted row by row.
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert not {"from_bank", "from_account", "to_bank", "to_account", "amount_received"} & set(rows.columns)
    full = with_parts(rows)
    off = full.where(
        "concat(from_bank, '-', from_account) <> from_node or concat(to_bank, '-', to_account) <> to_node "
        "or length(from_bank) <> 3 or amount_received <> amount_paid"
    )
    legs = {r.leg: r["count"] for r in full.groupBy("leg").count().collect()}
    orders, lines = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "lineitem"))
    assert off.count() == 0 and legs == {
        "pay": orders.count(), "cancel": orders.where("o_orderkey % 7 = 0").count(), "self": orders.where("o_orderkey % 9 = 0").count(),
        "line": lines.count(), "refund": lines.where("l_returnflag = 'R'").count(),
    }
