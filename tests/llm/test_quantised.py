import numpy as np
from tests.llm.helpers import union_find

from flowtrail.llm import quantised

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, id int, list string"


def test_links_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = (centres[i % 12] + rng.normal(size=16) * [0.1, 0.25, 0.4][i % 3]).astype("f4")
        rows.append((i, v.tolist(), i % 12 % 2 if i % 50 else None))
    rows += [(500 + i, rows[7][1], rows[7][2]) for i in range(5)] + [rows[8], rows[8]]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [float("inf")] + [1.0] * 15, 1),
             (605, [None] + [1.0] * 15, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (None, rows[9][1], rows[9][2])]
    good = {r[0]: r for r in rows if r[0] is not None and r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    unit = {i: np.array(r[1], "f8") / np.linalg.norm(np.array(r[1], "f8")) for i, r in good.items()}
    links = [(a, b) for a in good for b in good if a < b and good[a][2] == good[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    root = union_find([r[0] for r in rows if r[0] is not None], links)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    for chunk in (2048, 16):
        got = quantised.near_vectors(table, chunk=chunk, recall=None).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_links == sum(r.vec_id in x for x in links)
            assert r.component_id == root.get(r.vec_id) and r.kept == (r.vec_id == r.component_id)
    assert len(links) > 500


def test_no_vectors(spark):
    assert quantised.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quantised.near_vectors(spark.createDataFrame([(1, None, 1, "", 1, "")], SCHEMA)).collect()[0].n_links == 0


def test_lists_asked_hold_the_links_and_are_few(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3000, 32))
    near = base[:1500] + rng.normal(size=(1500, 32)) * 0.06 * np.linalg.norm(base[:1500], axis=1, keepdims=True)
    rows = quantised.unit(np.concatenate([base, near]).tolist(), 32)
    index = quantised.Index(rows, 40)
    measured = index.tune(rows, 0.93, 0.999)
    assert measured >= 0.999
    reach = (2 - 2 * 0.93) ** 0.5
    own, gap = index.gaps(rows, reach)
    i, j = np.nonzero(np.triu(rows @ rows.T >= 0.93, 1))
    found = (gap[i, own[j]] <= index.share + quantised.EPS) & (gap[j, own[i]] <= index.share + quantised.EPS)
    assert len(i) > 1000 and found.mean() >= 0.99
    asked = (gap <= index.share + quantised.EPS).sum(axis=1).mean()
    index.share = 1.0
    assert asked < 15 < (gap <= 1 + quantised.EPS).sum(axis=1).mean()
    # Every list that can hold a neighbour is within the whole bound, whatever the direction.
    assert (gap[i, own[j]] <= 1 + 1e-9).all()
    table = spark.createDataFrame([(k, v.tolist(), 1, "x", 1, "y") for k, v in enumerate(rows.astype("f4"))], SCHEMA)
    got = {r.vec_id: r.n_links for r in quantised.near_vectors(table).collect()}
    real = quantised.unit(rows.astype("f4").astype(float).tolist(), 32)
    links = (real @ real.T >= 0.93).sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * links.sum() and all(n <= links[k] for k, n in got.items())
