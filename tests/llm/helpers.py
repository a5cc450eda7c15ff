"""Rows that every operator on documents has to bear, and small brute-force versions."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, kept string, score string, size int"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 5, "x", "y", 7)


def odd_rows():
    """Null and empty cells, blank and very long texts, repeated rows, null ids; extra columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        row(9_000_100, None), row(9_000_101, ""), row(9_000_102, " \t\n\x0b "), row(9_000_103, "one"), row(9_000_104, long, None, None),
        row(9_000_105, "same text in both rows here", "de", "b"), row(9_000_105, "same text in both rows here", "de", "b"),
        row(None, "a row that has no id at all", None, "b"), row(9_000_106, "é ü ▁ \x00 😀   x" + "y" * 300, "fr", ""),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def prose(n, seed=1, words=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("the of and to in is was for with on that by".split()) + str(rng.randrange(words)) for _ in range(n))


def union_find(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
