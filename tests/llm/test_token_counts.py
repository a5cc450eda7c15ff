import base64
import re
from collections import defaultdict

import tiktoken
from tests.llm.helpers import frame, odd_rows, prose, row

from flowtrail.llm import token_counts as T
from flowtrail.session import scratch_path

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k")
FILES = {n: T.ranks_file(n) for n in NAMES}


def test_totals_are_those_of_the_final_state_however_often_batches_come(spark):
    rows = [row(i, prose(30, i % 17) + ("  two  blanks " if i % 3 else ""), ["en", "de", None][i % 3], ["a", "b", None][i % 2]) for i in range(60)]
    rows += odd_rows()
    batches = T.history(frame(spark, rows), FILES, *NAMES)
    rollup = T.Rollup(spark, scratch_path(spark, "totals"))
    assert rollup.totals().count() == 0
    assert [rollup.commit(n, d) for n, d in batches.items()] == [True] * 4
    first = sorted(rollup.totals().collect(), key=str)
    assert not rollup.commit("2-copies-leave", batches["2-copies-leave"])
    other = T.Rollup(spark, rollup.folder)  # another writer sees the same commits
    assert not other.commit("4-moved", batches["4-moved"]) and sorted(other.totals().collect(), key=str) == first

    def count(text, name):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, FILES[name].splitlines())}
        return len(tiktoken.Encoding(name, pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text or ""))

    best = {}
    for doc_id, text, lang, source, *_ in rows:
        key = (doc_id is not None, doc_id or 0, source is not None, source or "", lang is not None, lang or "")
        if text not in best or key < best[text][0]:
            best[text] = (key, source, lang)
    want = defaultdict(lambda: [0, 0])
    for text, (_, source, lang) in best.items():
        name = NAMES[0] if lang == "en" else NAMES[1]
        tidy = None if text is None else re.sub("[ \t]+", " ", text).strip(" ")
        total = want[source, lang, name]
        total[0] += 1
        total[1] += count(tidy, name)
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in first} == dict(want)


def test_a_writer_lost_before_its_commit_counts_for_nothing(spark):
    rollup = T.Rollup(spark, scratch_path(spark, "totals"))
    delta = spark.createDataFrame([("a", "en", "t", 1, 10)], T.TOTALS)
    delta.write.parquet(f"{rollup.folder}/data/b1-lost")
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", delta) and rollup.totals().collect()[0].tokens == 10
    assert rollup.commit("b2", delta.selectExpr("source", "lang", "tokenizer", "-docs as docs", "-tokens as tokens"))
    assert rollup.totals().count() == 0


def test_empty_table(spark):
    rollup = T.Rollup(spark, scratch_path(spark, "totals"))
    for name, delta in T.history(frame(spark, []), FILES, *NAMES).items():
        rollup.commit(name, delta)
    assert rollup.totals().count() == 0
