"""Histogram boosting against a plain version that grows one split's trees row by row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtrail.operators import boosting, ranker

NAMES = ("a", "b", "c")


def toy(n=260, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        a = None if rng.random() < 0.3 else float(rng.randrange(12))
        b = rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.random() * 10 // 1
        c = float(rng.randrange(3))
        odds = (a is None) * 2 + (b if b == b and b is not None else 4) / 3 - c
        label = int(rng.random() < 1 / (1 + math.exp(1.5 - odds)))
        held = [s for s in range(2) if rng.random() < 0.3]
        rows.append((i, a, b, c, float(label), held))
    return rows


def missing(x):
    return x is None or x != x


def plain(rows, split, params):
    """Probabilities of all rows by trees grown without bins, weights or histograms."""
    own = [i for i, r in enumerate(rows) if split not in r[5]]
    values = {f: sorted({r[1 + f] for r in rows if not missing(r[1 + f])}) for f in range(3)}
    y = [r[4] for r in rows]
    rate = sum(y[i] for i in own) / len(own)
    raw = [math.log(rate / (1 - rate))] * len(rows)
    for _ in range(params.rounds):
        p = [1 / (1 + math.exp(-x)) for x in raw]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def goes_left(i, cut, g=g):
            f, at, side = cut
            x = rows[i][1 + f]
            return side if missing(x) else x <= at

        def grow(train, rest, depth):
            sg, sh = sum(g[i] for i in train), sum(h[i] for i in train)
            best, pick = 1e-12, None
            for f in range(3):
                for at in values[f]:
                    for side in (False, True):
                        left = [i for i in train if goes_left(i, (f, at, side))]
                        right = [i for i in train if not goes_left(i, (f, at, side))]
                        if min(len(left), len(right)) < params.least_rows:
                            continue
                        gl, hl, gr, hr = (sum(v[i] for i in part) for part in (left, right) for v in (g, h))
                        gain = gl * gl / hl + gr * gr / hr - sg * sg / sh
                        if gain > best + 1e-9 and min(hl, hr) >= params.least_weight:
                            best, pick = gain, (f, at, side)
            if depth == params.depth or pick is None:
                for i in [*train, *rest]:
                    raw[i] += params.rate * -sg / sh
                return
            f, at, side = pick
            counts = [sum(not missing(rows[i][1 + f]) and rows[i][1 + f] <= v for i in train) for v in values[f]]
            alike = [k for k, c in enumerate(counts) if c == counts[values[f].index(at)]]
            pick = (f, values[f][(alike[0] + alike[-1] + 1) // 2], side)
            if not any(missing(rows[i][1 + f]) for i in train):
                n_left = sum(goes_left(i, pick) for i in train)
                pick = (*pick[:2], n_left > len(train) - n_left)
            parts = [[[i for i in part if goes_left(i, pick) == way] for part in (train, rest)] for way in (True, False)]
            for train_part, rest_part in parts:
                grow(train_part, rest_part, depth + 1)

        grow(own, [i for i in range(len(rows)) if i not in set(own)], 0)
    return [1 / (1 + math.exp(-x)) for x in raw]


@pytest.mark.parametrize("rewrite, partition_rows, merged_here", [(2, 50, 16), (10, 25_000, 16), (3, 40, 1)])
def test_scores_are_those_of_the_plain_version(spark, rewrite, partition_rows, merged_here):
    rows, params = toy(), boosting.BoostParams(rounds=5, rate=0.3, depth=3, least_rows=10, rewrite=rewrite, partition_rows=partition_rows, merged_here=merged_here)
    table = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, held_out array<int>").repartition(4)
    forest = boosting.fit(table, NAMES, 2, params)
    assert len(forest.trees) == 5
    got = sorted(forest.score(table, ["p0", "p1"]).collect())
    for s, c in ((0, "p0"), (1, "p1")):
        assert [r[c] for r in got] == pytest.approx(plain(rows, s, params), abs=1e-6)


def test_trees_do_not_depend_on_partitions_or_copies(spark):
    table = spark.createDataFrame(toy(), "id int, a double, b double, c double, label double, held_out array<int>")
    params = boosting.BoostParams(rounds=3, rate=0.3, depth=2, least_rows=10)
    one, two = (boosting.fit(t, NAMES, 2, params) for t in (table.coalesce(1), table.repartition(7)))
    assert all((a.feature == b.feature).all() and (a.value == b.value).all() for a, b in zip(one.trees, two.trees))
    # Each row three times: the same cuts, as every sum is three times as large.
    many = boosting.fit(table.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))), NAMES, 2, boosting.BoostParams(rounds=3, rate=0.3, depth=2, least_rows=30))
    assert all((a.feature == b.feature).all() and abs(a.value - b.value).max() < 1e-9 for a, b in zip(one.trees, many.trees))


def test_one_label_and_no_rows_are_borne(spark):
    schema = "id int, a double, b double, c double, label double, held_out array<int>"
    rows = [(i, None, float(i), 1.0, float(i % 2), [0] if i % 2 else []) for i in range(60)]
    forest = boosting.fit(spark.createDataFrame(rows, schema), NAMES, 2, boosting.BoostParams(rounds=2, least_rows=5))
    got = forest.score(spark.createDataFrame(rows, schema), ["p0", "p1"]).collect()
    assert all(r.p0 < 1e-9 and 0 < r.p1 < 1 for r in got)
    none = spark.createDataFrame([], schema)
    assert [r.p0 for r in boosting.fit(none, NAMES, 1).score(spark.createDataFrame(rows[:1], schema), ["p0"]).collect()] == [0.5]


def test_average_precision_by_hand(spark):
    rows = spark.createDataFrame([(0.9, 1.0), (0.8, 0.0), (0.8, 1.0), (0.1, 1.0), (0.0, 0.0)], "p double, label double")
    # Recall rises by 1/3 at precisions 1, 2/3 and 3/4.
    assert ranker.average_precision(rows, {"x": "p"}, "curve")["x"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)


def test_only_the_smaller_child_is_counted_and_sums_are_whole(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 4, (400, 3)).astype(np.uint8)
    codes[::7, 1] = boosting.MISSING
    trees = boosting.Trees.empty(1, 2)
    trees.feature[0, 0], trees.cut[0, 0], trees.missing_left[0, 0] = 1, 0, True
    left = (codes[:, 1] <= 0) | (codes[:, 1] == boosting.MISSING)
    trees.rows[0, 1:3] = left.sum(), (~left).sum()
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(rng.integers(0, 2, 400).astype(float)), pa.array([b"\x01"] * 400, pa.binary()),
         pa.array(np.ones(400, np.int64)), pa.array([np.zeros(1).tobytes()] * 400, pa.binary())], ["codes", "label", "trains", "weight", "raw"],
    )

    def sums(level):
        shape = (1, 2**level, 3, 6)
        out = np.zeros((3, int(np.prod(shape))), np.int64)
        (got,) = boosting.histogram([batch], trees, level, [], shape, 0.1)
        for k, c in enumerate("ghn"):
            out[k, got["cell"].to_numpy()] = got[c].to_numpy()
        return out.reshape(3, *shape)

    one = sums(1)
    assert one[2].sum() == 3 * min(left.sum(), (~left).sum())
    whole = trees.completed(1, one, sums(0))
    for node, rows in enumerate((left, ~left)):
        want = [np.bincount(np.where(codes[rows, f] == boosting.MISSING, 5, codes[rows, f]), minlength=6) for f in range(3)]
        assert (whole[2, 0, node] == want).all()
    assert (whole.sum(axis=2) == sums(0)[:, :, 0]).all()


def test_rows_of_other_splits_are_folded_into_one(spark):
    held = [[], [0], [1], [0, 1]]
    rows = [(i, 1.0, None, 3.0, 1.0, held[i % 4]) for i in range(40)] + [(40, 1.0, None, 3.0, 0.0, [])]
    table = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, held_out array<int>").repartition(3)
    got = boosting.folded(table, boosting.Binner(NAMES, [np.array([1.0, 2.0])] * 3), 2).orderBy("label").collect()
    assert [(r.label, r.w0, r.w1) for r in got] == [(0.0, 1, 1), (1.0, 20, 20)]


def test_each_task_sends_one_row_of_sums(spark):
    rows = [(i, float(i % 9), None, float(i % 5), float(i % 2), [i % 2]) for i in range(300)]
    table = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, held_out array<int>")
    binner = boosting.Binner(NAMES, [np.arange(8.0), np.array([]), np.arange(4.0)])
    state = boosting.packed(boosting.folded(table, binner, 2), np.zeros(2)).repartition(7).persist()
    trees, shape = boosting.Trees.empty(2, 2), (2, 1, 3, 10)
    alone, grouped = (boosting.level_sums(state, trees, 0, [], shape, 0.1, g) for g in (None, 2))
    assert (alone == grouped).all()
    assert alone[2].sum(axis=(1, 3)).tolist() == [[150] * 3] * 2
