import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.helpers import frame, odd_rows, row

from flowtrail.llm import phrases


def brute(rows, least, longest=5, top=2000):
    f, n = {}, Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= 100 * counts[p[i:j]]:
                        gone.add(p[i:j])
        rows = []
        for p, a in often.items():
            if p not in gone:
                s, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), l, r))
        rows.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows[:top])]
    return sorted(out)


def corpus(n=300):
    rng, rows = random.Random(6), []
    fixed = ["New York City hall", "the quick brown fox jumps", "à la carte", "x\x85y z", "a a a a a a"]
    for i in range(n):
        words = []
        for _ in range(rng.randrange(40)):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice("the of and to in is was I".split()) + rng.choice(["", "", "1"]))
            words.append(rng.choice([" ", "  ", "\t", ", ", ".\n", " ; "]))
        rows.append(row(i, "".join(words), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + odd_rows()


@pytest.mark.parametrize("least, block_words, bucket_words", [(12, 1 << 20, 1 << 21), (5, 200, 300), (30, 1, 5000)])
def test_phrases_are_those_of_the_plain_version(spark, monkeypatch, least, block_words, bucket_words):
    monkeypatch.setattr(phrases, "BUCKET_WORDS", bucket_words)
    rows = corpus()
    out = phrases.collocations(frame(spark, rows), least, block_words=block_words)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least)
    assert sorted(map(tuple, out.collect())) == want and len(want) > 20


def test_top_and_ties(spark):
    rows = [row(i, f"p{k} q{k}. r{k} s{k}", "en") for k in range(6) for i in range(10)]
    out = sorted(map(tuple, phrases.collocations(frame(spark, rows), 10, top=5).collect()))
    assert out == brute(rows, 10, top=5) and [r[2] for r in out] == ["p0 q0", "p1 q1", "p2 q2", "p3 q3", "p4 q4"]


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, f = 300_000_000_007, 900_000_000_000_011, [400_000_000_003, 310_000_000_001]
    row = spark.createDataFrame([(a, n, f, f[::-1])], "a long, n long, heads array<long>, tails array<long>").select(phrases.lowest_cut().alias("b")).head().b
    assert (row.score, row.k) == (1000 * a * n // (f[0] * f[1]), 0) and (row.l, row.r) == (f[0], f[1])


def test_nothing_frequent_and_empty_table(spark):
    assert phrases.collocations(frame(spark, odd_rows()[:5]), 100_000).count() == 0
    assert phrases.collocations(frame(spark, []), 1).count() == 0


def test_crowded_tiles_and_sorted_coordinates_count_alike(monkeypatch):
    rng = np.random.default_rng(1)
    units = np.minimum(rng.zipf(1.2, 100_000), 5000) * 3 - 3 * (rng.random(100_000) < 0.01)
    units[rng.random(100_000) < 0.1] = -1
    want = Counter((a, b) for a, b in zip(units.tolist(), units[1:].tolist()) if a >= 0 and b >= 0)
    for crowded in (1, 1000, 1 << 30):
        monkeypatch.setattr(phrases, "CROWDED", crowded)
        i, j, n = phrases.counted(units)
        assert dict(zip(zip(i.tolist(), j.tolist()), n.tolist())) == want
    assert [len(x) for x in phrases.counted(np.array([-1, 4, -1]))] == [0, 0, 0] == [len(x) for x in phrases.counted(np.empty(0, int))]


def test_a_text_in_slices_keeps_its_pieces():
    data = b"a b\nc d e\nf\n" * 50 + b"tail without stop"
    parts = list(phrases.slices(data, 40))
    assert b"".join(parts) == data and all(p.endswith(b"\n") for p in parts[:-1]) and max(map(len, parts)) < 60
