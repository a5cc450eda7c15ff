from collections import defaultdict

from tests.llm.helpers import WORD, frame, odd_rows, prose, row

from flowtrail.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), repeat=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeat * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(repeat * sizes[s])
            left -= target[s]
            free.remove(s)


def brute_quotas(shares, seats):
    got = [0] * len(shares)
    for _ in range(seats):
        k = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_highest_quotients(spark):
    for n, shares in enumerate([[5.0, 3.0, 1.0], [100.0, 1.0, 1.0, 1.0], [7.0], [2.0, 2.0, 2.0, 2.0, 2.0], [0.0, 0.0, 3.0]]):
        for seats in (0, 1, 2, 5, 17, 100):
            rows = spark.createDataFrame([("g", i, s, seats) for i, s in enumerate(shares)], "g string, k int, s double, n long")
            got = {r.k: r.quota for r in mixing.sainte_lague(rows, ["g"], "k", "s", "n").collect()}
            assert [got[i] for i in range(len(shares))] == brute_quotas(shares, seats), (n, seats)


def test_targets_and_taken_words(spark):
    rows = [row(i, prose(20 + i % 90, i), source=["b", "a", "c", "d", None][i % 5]) for i in range(150)]
    rows += [row(1000 + i, "tiny text here", source="e") for i in range(3)] + odd_rows()
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    # A small shard, so that one source has several.
    got = mixing.mix(frame(spark, rows), shard_tokens=700).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in size)
    again = mixing.mix(frame(spark, rows[::-1]), shard_tokens=700).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and sorted(got, key=key)


def test_nothing_to_mix(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [row(1, None), row(2, " ")])).collect()] == [0, 0]
