import random

from tests.llm.helpers import frame, odd_rows, prose, row, union_find

from flowtrail.llm import minhash
from flowtrail.llm.common import components


def brute(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    links = [
        (a, b) for a in ids for b in ids
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    return sets, union_find(ids, links)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows, base = [], [prose(120, s) for s in range(6)]
    for i in range(120):
        words = base[i % 6].split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        rows.append(row(i, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    rows += odd_rows()
    sets, root = brute(rows)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == root.get(r.doc_id)
        assert r.kept == (r.doc_id == r.component_id)
    assert len({r.component_id for r in got}) < len(rows) - 20  # there were links
    kept = minhash.deduplicated(frame(spark, rows))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(root.values()))
    assert kept.where("doc_id is null").count() == 1 and kept.columns == frame(spark, rows).columns


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_parity_never_exceeds_the_difference():
    import numpy as np

    a, b = minhash.shingles(prose(300, 1)), minhash.shingles(prose(200, 1) + " " + prose(90, 2))
    bits = [minhash.parity((x % minhash.U(1024)).astype(np.int64), 1024) for x in (a, b)]
    assert sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_components_of_a_path_a_hub_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


def test_sketch_limit_and_bands_follow_the_threshold():
    import numpy as np
    import pandas as pd
    import pytest

    # Pairs of about 80 %: their sketches stay within the limit of 80.
    texts = []
    for i in range(300):
        items = [f"t{i}_{k}" for k in range(450)]
        texts.append([" ".join(f"{x} a b c d" for x in items[a : a + 405]) for a in (0, 45)])
    limit = minhash.odd_limit(80)
    assert minhash.odd_limit(85) < limit < minhash.SKETCH_BITS / 2

    flat = pd.DataFrame({"doc_id": range(600), "text": [t for pair in texts for t in pair]})
    (signed,) = minhash.sign([flat])
    bits = signed[minhash.SKETCH].to_numpy().astype(np.int64)
    far = [sum(int(x).bit_count() for x in (bits[i] ^ bits[i + 1]).view(np.uint64)) for i in range(0, 600, 2)]
    assert max(far) <= limit
    assert minhash.missed(80) < minhash.MOST_MISSED
    with pytest.raises(ValueError):
        minhash.near_duplicates(None, 60)


def test_bitmaps_refuse_unlike_pairs_and_no_link(spark):
    rng, rows, pairs = random.Random(12), [], []
    for i in range(60):
        words = prose(200, 700 + i).split()
        copy = list(words)
        for at in rng.sample(range(200), 3 if i % 2 else 40):
            copy[at] = f"other{at}"
        rows += [row(2 * i, " ".join(words)), row(2 * i + 1, " ".join(copy))]
        pairs.append((2 * i, 2 * i + 1))
    docs = frame(spark, rows)
    sketches = docs.select("doc_id", "text").mapInPandas(minhash.sign, minhash.SIGNED)
    left = {(r.a, r.b) for r in minhash.not_refused(spark.createDataFrame(pairs, "a long, b long"), sketches, 85).collect()}
    sets = {r[0]: set(minhash.shingles(r[1]).tolist()) for r in rows}
    alike = {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert alike <= left and len(alike) > 20 and len(left) < 40
