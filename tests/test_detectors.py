import itertools
import random

import pytest
from pyspark.sql import functions as F

from flowtrail.operators import cycles, detectors, graph
from flowtrail.functions import skew
from flowtrail.operators.filters import search_slice
from flowtrail.params import DetectionParams
from flowtrail.plans.detect import Detection


def tables(df):
    run = Detection(df)
    run.search = df
    return run.accounts, run.edges


def test_search_slice(transfers):
    df = transfers([("A", "B", 1, 0), ("C", "D", 1, 0, {"rail": "Cheque"}), ("S", "S", 1, 0)])
    assert [r.from_node for r in search_slice(df).collect()] == ["A"]
    assert search_slice(df, ()).count() == 2


def test_edges_aggregate_and_keep_self_only_accounts(transfers):
    df = transfers([("A", "B", 10, 0), ("A", "B", 15, 5), ("S", "S", 1, 0), ("A", "A", 1, 0)])
    row = graph.edge_table(df).collect()
    assert len(row) == 1 and (row[0]["count"], row[0]["total_amount"]) == (2, 25.0)
    assert (row[0]["last_seen"] - row[0]["first_seen"]).total_seconds() == 5 * 3600
    assert {r.node: r.self_loop_count for r in graph.node_table(df).collect()} == {"A": 1, "B": 0, "S": 1}


def test_star_band_both_ends(transfers):
    small = [("H", f"L{i}", 5, 0) for i in range(2)]
    big = [("G", f"M{i}", 5, 0) for i in range(35)]
    _, edges = tables(transfers(small + big))
    assert detectors.fan_out(edges).count() == 0


def test_uniform_tight_star_scores_higher(transfers):
    rows = [("U", f"a{i}", 100, 0) for i in range(5)] + [("V", f"b{i}", 100 * (i + 1), 24 * i) for i in range(5)]
    _, edges = tables(transfers(rows))
    score = {r.evidence.hub: r for r in detectors.fan_out(edges).collect()}
    assert score["U"].score == 1.0 and score["U"].score > score["V"].score
    assert score["U"].accounts == ["U", "a0", "a1", "a2", "a3", "a4"]
    assert score["V"].evidence.degree == 5 and score["V"].evidence.total_amount == 1500.0
    # mean 300, sample deviation 158.11, span 96 h of 144 h
    assert score["V"].evidence.tightness == 0.333 and score["V"].evidence.uniformity == 0.473


def test_star_spread_over_repeated_edges_matches_row_level(transfers, spark):
    rng = random.Random(3)
    rows = [("H", f"L{rng.randrange(6)}", rng.randrange(100, 10**7) / 100, rng.random() * 50) for _ in range(60)]
    df = transfers(rows)
    _, edges = tables(df)
    got = detectors.star_statistics(edges, True, DetectionParams()).head()
    want = df.agg(F.stddev_samp("amount_paid").alias("s"), F.avg("amount_paid").alias("m")).head()
    assert got.std_amount == pytest.approx(want.s, rel=1e-12)
    assert got.mean_amount == pytest.approx(want.m, rel=1e-12)


def test_fan_in_mirrors_fan_out(transfers):
    _, edges = tables(transfers([(f"a{i}", "H", 7, i) for i in range(4)]))
    row = detectors.fan_in(edges).collect()
    assert len(row) == 1 and row[0].evidence.hub == "H" and detectors.fan_out(edges).count() == 0


def run_pass(df):
    accounts, _ = tables(df)
    return detectors.pass_through(df, accounts).collect()


def test_pass_through_match_and_mismatch(transfers):
    hit = run_pass(transfers([("A", "M", 1000, 0), ("M", "B", 1000, 24)]))
    assert len(hit) == 1 and hit[0].accounts == ["A", "B", "M"] and hit[0].evidence.hold_hours == 24.0
    assert hit[0].score == pytest.approx(0.6 + 0.4 * 0.9)
    assert run_pass(transfers([("A", "M", 1000, 0), ("M", "B", 5, 24)])) == []
    assert run_pass(transfers([("A", "M", 0, 0), ("M", "B", 0, 24)])) == []
    assert run_pass(transfers([("A", "M", 1000, 24), ("M", "B", 1000, 0)])) == []


def test_pass_through_bounds_and_same_payer_payee(transfers):
    assert run_pass(transfers([("A", "M", 1000, 0), ("M", "B", 1100, 240)]))[0].score == pytest.approx(0, abs=1e-9)
    assert run_pass(transfers([("A", "M", 1000, 0), ("M", "B", 1000, 240.1)])) == []
    both = run_pass(transfers([("A", "M", 1000, 0), ("M", "A", 990, 1)]))
    assert both[0].accounts == ["A", "M"]


def test_pass_through_takes_closest_then_earliest(transfers):
    rows = [("A", "M", 1000, 0), ("M", "B", 1050, 1), ("M", "C", 1000, 5), ("M", "D", 1000, 3)]
    assert run_pass(transfers(rows))[0].accounts == ["A", "D", "M"]


def test_volume_cap_excludes_busy_accounts(transfers):
    rows = [("A", "M", 1000, 0), ("M", "B", 1000, 1)] + [(f"x{i}", "M", 3, 2) for i in range(60)]
    assert run_pass(transfers(rows)) == []


def test_burst_edges(transfers):
    def burst(hours):
        accounts, _ = tables(transfers([("A", f"p{i}", 1, h) for i, h in enumerate(hours)]))
        return [r for r in detectors.velocity_burst(accounts).collect() if r.accounts == ["A"]]

    assert burst([0, 12, 24])[0].score == 0.0
    assert burst([0, 3, 6])[0].score == pytest.approx(0.75)
    assert burst([0, 0, 0]) == [] and burst([0, 1, 25]) == [] and burst([0, 1]) == []


def brute_cycles(edges, limit):
    """Every simple directed cycle by exhaustive walk, one smallest path per account set."""
    out = {}
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, set()).add(b)

    def walk(path):
        for b in nxt.get(path[-1], ()):
            if b == path[0] and len(path) >= 2:
                key = tuple(sorted(path))
                out[key] = min(out.get(key, tuple(path)), tuple(path))
            elif b not in path and b > path[0] and len(path) < limit:
                walk(path + [b])

    for start in nxt:
        walk([start])
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [2, 3, 4, 5, 7])
def test_cycles_match_exhaustive_search(transfers, seed, limit):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    pairs = {(a, b) for a, b in itertools.product(names, names) if a != b and rng.random() < 0.25}
    pairs |= {("n0", b) for b in names if b != "n0"}  # a hub
    _, edges = tables(transfers([(a, b, 1, 0) for a, b in pairs]))
    got = {tuple(r.accounts): tuple(r.evidence.path) for r in cycles.cycles(edges, limit).collect()}
    assert got == brute_cycles(pairs, limit)


def test_cycles_and_pairs_broadcast_no_table_that_grows(transfers):
    run = Detection(transfers([("a", "b", 1, 0), ("b", "c", 1, 1), ("c", "a", 1, 2)]), DetectionParams(rails=()))
    plan = cycles.cycles(run.edges, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_triangle_orientations_and_hamiltonian_cycles_collapse(transfers):
    both = [(a, b, 1, 0) for a, b in itertools.permutations("ABC", 2)]
    _, edges = tables(transfers(both))
    rows = cycles.cycles(edges, 3).collect()
    assert sorted(len(r.accounts) for r in rows) == [2, 2, 2, 3]
    full = [(a, b, 1, 0) for a, b in itertools.permutations("ABCD", 2)]
    _, edges = tables(transfers(full))
    assert sum(len(r.accounts) == 4 for r in cycles.cycles(edges, 4).collect()) == 1
    with pytest.raises(ValueError):
        cycles.cycles(edges, 1)


def test_only_cycles_of_the_lengths_asked_for_are_looked_for(transfers, monkeypatch):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(11)}", f"n{rng.randrange(11)}") for _ in range(60)}
    pairs = {(a, b) for a, b in pairs if a != b}
    _, edges = tables(transfers([(a, b, 1, 0) for a, b in pairs]))
    monkeypatch.setattr(cycles, "three_cycles", None)
    monkeypatch.setattr(cycles, "four_cycles", None)
    got = {tuple(r.accounts): tuple(r.evidence.path) for r in cycles.cycles(edges, 6, 5).collect()}
    assert got and got == {k: v for k, v in brute_cycles(pairs, 6).items() if len(k) >= 5}
    with pytest.raises(ValueError):
        cycles.cycles(edges, 4, 5)


def test_smallest_paths_are_found_by_number_and_by_array(spark):
    names = [f"n{i:02}" for i in range(15)]
    paths = [[names[0], *rest] for rest in itertools.permutations(names[1:4])] + [names, [names[0], *reversed(names[1:])]]
    rows = spark.createDataFrame([(p,) for p in paths], "path array<string>")
    by = {n: cycles._smallest_paths(rows, n) for n in (15, 16)}
    for got in by.values():
        assert sorted((r.accounts, r.path) for r in got.collect()) == sorted([(names[:4], names[:4]), (names, names)])
    plans = {n: d._jdf.queryExecution().executedPlan().toString() for n, d in by.items()}
    assert "SortAggregate" not in plans[15] and "SortAggregate" in plans[16]


def test_half_paths_are_gone_before_cycles_are_grouped(transfers, monkeypatch):
    gone = []
    monkeypatch.setattr(cycles, "release", lambda t: gone.extend({f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in t.inputFiles()}))
    _, edges = tables(transfers([(f"n{i}", f"n{(i + 1) % 6}", 1, 0) for i in range(6)]))
    assert [r.path for r in cycles.cycles(edges, 6).select("evidence.path").collect()] == [[f"n{i}" for i in range(6)]]
    assert sorted(gone) == ["cycle-edges", *["half-paths"] * 4]


def test_order_and_partitioning_do_not_matter(transfers, spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}", rng.randrange(1, 9) * 100, rng.randrange(200)) for _ in range(150)]
    first = Detection(transfers(rows)).rings
    rng.shuffle(rows)
    second = Detection(transfers(rows).repartition(7)).rings
    cols = ["ring_id", "accounts", "signals", F.round("score", 9), F.size("evidence")]
    assert first.select(*cols).orderBy("ring_id").collect() == second.select(*cols).orderBy("ring_id").collect()


def test_hot_account_takes_the_heavy_paths_with_equal_results(transfers, monkeypatch):
    """One account on a third of all transfers: results equal those of the plain joins."""
    rng = random.Random(6)
    name = lambda: f"n{rng.randrange(20)}"
    rows = [("HOT", name(), 100, rng.randrange(200)) for _ in range(90)]
    rows += [(name(), "HOT", 100, rng.randrange(200)) for _ in range(45)]
    rows += [(name(), name(), rng.choice([100, 105, 300]), rng.randrange(200)) for _ in range(170)]
    cols = ["ring_id", "accounts", "signals", F.round("score", 9)]
    plain = Detection(transfers(rows)).rings.select(*cols).orderBy("ring_id").collect()
    monkeypatch.setattr(skew, "LIGHT_ROWS", 15)
    monkeypatch.setattr(skew, "MAX_HEAVY_KEYS", 20)
    monkeypatch.setattr(skew, "SKETCH_KEYS", 20)
    run = Detection(transfers(rows))
    assert skew.heavy_keys(run.accounts, "out_degree").count() >= 1
    assert plain == run.rings.select(*cols).orderBy("ring_id").collect()
