from collections import Counter

import duckdb
from tests.llm.helpers import WORD, frame, odd_rows, prose, row

from flowtrail.llm import oracle, quality_rules


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    common = "Share this article with 12 friends today"
    rows = [row(i, f"{common}\n{prose(40, i)}\n{common.upper().replace('12', '99')}") for i in range(8)]
    rows += [row(20 + i, f"{common}\n{common}\nshort own line {i} here") for i in range(8)]
    rows += [row(40, "a b c d e f g a b c d e f g x"), row(41, "# *|<>$%& x y\nx y\n\nx y"), row(42, "a a a a a a a a a a a a")]
    rows += [row(50, prose(40, 60)), row(51, prose(40, 60)), row(52, f"{common}\n{prose(3, 1)}", source="other")] + odd_rows()
    got = quality_rules.quality(frame(spark, rows), least_docs=5, max_lost_percent=70).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for r in rows:
        g = by[r[0]]
        n, *rest = brute(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, *rest), r[0]
        assert g.base_failed == (n < 10 or 100 * rest[-1] > 20 * n)
    # Kept where most words are the document's own, though it holds the common line twice.
    assert all(by[i].kept and by[i].n_lost_words == 14 for i in range(8))
    assert not any(by[20 + i].kept for i in range(8)) and all(by[20 + i].n_lost_words == 19 for i in range(8))
    assert by[50].kept and by[51].kept


def test_empty_table(spark):
    assert quality_rules.quality(frame(spark, [])).count() == 0


def test_equals_its_sql_where_the_line_rule_fires(spark, tmp_path):
    common, other = "Share this article with 12 friends today", "Read more on our other pages"
    rows = [row(i, f"{common}\n{prose(30, i)}\n\n{other if i < 6 else ''}") for i in range(130)]
    rows += [row(200 + i, f"{common}\n{common.upper()}\nown {i}", source="a") for i in range(5)]
    rows += [row(300 + i, f"{common if i < 5 else ''}\n{prose(30, i)}", source="b") for i in range(100)] + [row(400 + i, rows[0][1]) for i in range(5)]
    rows += [row(500 + i, f"{common}\n{common}", source=None) for i in range(9)] + [row(600, None), row(601, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_lines", "n_lost_words",
             "cleaned_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle.SQL['op5_quality_rules']})").fetchall()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in quality_rules.quality(docs).select(*names).collect()]
    assert sorted(got) == sorted(want)
    by = {r[0]: dict(zip(names, r)) for r in got}
    # ``other`` stands on the six copies of document 0 and five more of the 142 documents of their host; the rest of document 0 only on six.
    assert by[0]["n_lost_words"] == 7 + 6 and by[10]["n_lost_words"] == 7 and by[0]["kept"] and not by[200]["kept"]
    assert by[300]["n_lost_words"] == 0 and by[500]["n_lost_lines"] == 2


def test_few_and_many_boilerplate_lines_give_the_same(spark, monkeypatch):
    rows = [row(i, f"line {'abc'[i % 3]} of many\n{prose(30, i)}\nshared tail") for i in range(40)] + odd_rows()
    sent = sorted(map(str, quality_rules.quality(frame(spark, rows)).collect()))
    monkeypatch.setattr(quality_rules, "MOST_SENT", 0)
    assert sorted(map(str, quality_rules.quality(frame(spark, rows)).collect())) == sent


def test_share_of_the_host_acts_alike_at_every_size(spark):
    for n in (20, 200):
        rows = [row(i, f"{'common line of words' if i % 2 else f'own {chr(97 + i % 26)} {chr(97 + i // 26)}'}\n{prose(30, i)}") for i in range(n)]
        rows += [row(1000 + i, prose(30, 900 + i), source="b") for i in range(3 * n)]
        got = quality_rules.quality(frame(spark, rows), line_percent=40).collect()
        assert sum(r.n_lost_words for r in got) == n // 2 * 4
        none = quality_rules.quality(frame(spark, rows), line_percent=60).collect()
        assert not any(r.n_lost_words for r in none)


def test_cleaned_takes_lines_out_and_rejects_depleted_documents(spark):
    common = "Share this article with 12 friends today"
    rows = [row(i, f"  {common}\n\n{prose(40, i)}\r\n{common.upper().replace('12', '99')}\n tail {'abcdefgh'[i]} ") for i in range(8)]
    rows += [row(20 + i, f"{common}\n{common}\nshort own line {'abcdefgh'[i]} here") for i in range(8)] + [row(0, rows[0][1])]
    rows += [row(50, f"{common}\n{prose(20, 50)}", source="other"), row(None, f"{prose(20, 51)}\n{common}", source="a")] + odd_rows()
    docs = frame(spark, rows).withColumnsRenamed({"kept": "_text_key", "score": "text_key", "size": "gone"})
    out = quality_rules.cleaned(docs)
    assert out.dtypes == docs.dtypes and {tuple(r)[6:] for r in out.collect()} == {("x", "y", 7)}
    got = sorted(((r.doc_id is None, r.doc_id), r.text) for r in out.collect() if r.doc_id is None or r.doc_id < 100)
    want = [((False, i), f"\n{prose(40, i)}\r\n tail {'abcdefgh'[i]} ") for i in [0, *range(8)]]
    want += [((False, 50), rows[17][1]), ((True, None), prose(20, 51))]
    assert [x for x in got if x[0] != (True, None)] == [x for x in want if x[0] != (True, None)]
    assert prose(20, 51) in [t for i, t in got if i[0]]
    judged = quality_rules.quality(docs)
    assert out.count() == judged.where("kept").count()
    # A text that loses nothing stays as it was.
    assert {r.text for r in quality_rules.cleaned(docs, least_docs=100).where("doc_id < 8").collect()} == {r[1] for r in rows[:8]}
