import random
from collections import defaultdict

from tests.llm.helpers import frame, odd_rows, prose, row

from flowtrail.llm import suffixes


def brute(rows):
    words = {r[0]: (r[1] or "").split() for r in rows if r[0] is not None}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(i)
    out = set()
    for i, w in words.items():
        spans = []
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k : k + 50])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + 50
                else:
                    spans.append([k, k + 50])
        out |= {(i, a, b) for a, b in spans}
    return out


def test_finds_all_passages_and_no_others(spark):
    rng = random.Random(8)
    passages = [prose(n, 900 + n, 5000) for n in (49, 50, 51, 55, 60, 75, 120)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(1, 60), i, 5000)]
        for p in rng.sample(passages, rng.randrange(3)):
            words = p.split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = f"edit{i}"
            parts += [" ".join(words), prose(rng.randrange(1, 40), 1000 + i, 5000)]
        rows.append(row(i, " ".join(parts)))
    rows += [row(70, rows[3][1]), row(71, " ".join([prose(60, 5, 5000)] * 2)), row(72, "the " * 400), row(73, "the " * 300)]
    rows += odd_rows()
    want = brute(rows)
    table = frame(spark, rows)
    for hot in (suffixes.HOT, 3):  # with 3, most runs take the way for hot ones
        got = suffixes.repeated_passages(table, hot).collect()
        assert {(r.doc_id, r.start_word, r.end_word) for r in got} == want
        assert all(r.other_doc_id != r.doc_id and r.n_words == r.end_word - r.start_word for r in got)
    assert len(want) > 20


def test_empty_table(spark):
    assert suffixes.repeated_passages(frame(spark, [])).count() == 0
