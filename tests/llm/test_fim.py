import hashlib
import random
import re

from pyspark.sql import functions as F
from tests.llm.helpers import frame, odd_rows, prose, row

from flowtrail.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of_all_kinds():
    rng = random.Random(3)
    parts = ["a", "é", "😀", " ", "\n", "\t", "<", "P", ">", "<P", "S>", "<M>", "x y", "\x0b", "word ", "\x85"]
    rows = [row(i, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for i in range(1500)]
    return rows + [row(2000 + i, prose(200 + i, i)) for i in range(40)] + odd_rows()


def test_outputs_are_those_of_the_plain_version(spark):
    rows = rows_of_all_kinds()
    out = fim.transform(frame(spark, rows))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(brute(r[0], r[1])) for r in rows)


def test_texts_come_back_from_output_and_form_alone(spark):
    rows = rows_of_all_kinds()
    made = fim.transform(frame(spark, rows)).select("doc_id", "form", "output", F.lit(1).alias("restored"))
    back = fim.restore(made)
    assert back.columns == ["doc_id", "form", "output", "restored"]
    assert sorted((str(r.doc_id), r.restored) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_runs_of_rows_do_not_change_results(spark, monkeypatch):
    rows = rows_of_all_kinds()[:300]
    whole = sorted(map(str, fim.transform(frame(spark, rows)).collect()))
    monkeypatch.setattr(fim, "RUN_BYTES", 64)
    assert sorted(map(str, fim.transform(frame(spark, rows)).collect())) == whole


def test_null_and_unknown_forms_are_plain_and_empty_tables_stay_empty(spark):
    odd = spark.createDataFrame([(1, None, "a<P>b"), (2, "other", None), (3, "psm", "no markers")], "doc_id long, form string, output string")
    assert {r.doc_id: r.restored for r in fim.restore(odd).collect()} == {1: "a<P>b", 2: "", 3: ""}
    assert fim.restore(fim.transform(frame(spark, []))).count() == 0
