import random

import corpus_pipeline
import numpy as np
import pytest
from tests.llm.helpers import WORD, odd_rows, prose, row

from flowtrail.llm import pieces, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with near copies, junk and personal data, and labels for some of them."""
    rng, out = random.Random(5), str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(240):
        text = prose(50 + i % 40, i)
        if i % 6 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 10 == 1:
            text += f" mail me at user{i}@mail.example.com or +1 (606) 555-0114 4111111111111112 now"
        rows.append(row(i, text, source=["a", "b", "c", None][i % 4]))
        if i % 2 == 0 or i < 60:
            labels.append((i, int(i % 6 != 0), 0))
    rows += [row(1000 + i, rows[i][1] + " end", source="d") for i in range(2, 40, 3) if i % 6]
    rng.shuffle(rows)
    rows += odd_rows()
    table = spark.createDataFrame([r[:5] for r in rows], SCHEMA)
    table.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages_take_effect_and_run_is_all_of_them(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        kept.append(docs.collect())
    good, single, clean, mix, ids = kept
    # Junk goes, prose stays.
    assert not any(r.doc_id is not None and r.doc_id < 240 and r.doc_id % 6 == 0 for r in good)
    assert {r.doc_id for r in good} >= {i for i in range(240) if i % 6}
    # Of a text and its near copy the smaller id stays; the copies of one row become one.
    named = [r.doc_id for r in single if r.doc_id is not None]
    assert len(named) == len(set(named)) and not any(1000 <= i < 1240 for i in named)
    assert set(named) >= {i for i in range(240) if i % 6}
    # Personal data is gone, nothing else is changed.
    before = {r.doc_id: r.text for r in single}
    for r in clean:
        text = before[r.doc_id]
        assert r.text is None if text is None else pii.base_spans(r.text) == []
        if text and not pii.base_spans(text):
            assert r.text == text
        assert r.n_chars is None or r.n_chars == len(r.text)
    # Every row of the mix is a document or a run of its words.
    whole = {r.doc_id: r.text for r in clean}
    assert all(r.text == whole[r.doc_id] or " ".join(WORD.findall(r.text)) in " ".join(WORD.findall(whole[r.doc_id])) for r in mix)
    assert max(sum(r.doc_id == i for r in mix) for i in {r.doc_id for r in mix}) <= 3
    # Encoding keeps every row.
    speller = pieces.Speller(pieces.Model.read().bytes_of)
    assert sorted(speller.text(np.array(r.ids)) for r in ids) == sorted(r.text for r in mix)
    final = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, final.collect())) == sorted(map(str, ids))


def test_near_copies_between_80_and_85_percent_become_one(spark):
    rng, rows, sets = random.Random(8), [], {}
    for i in range(60):
        words = prose(300, 500 + i).split()
        copy = list(words)
        for at in rng.sample(range(5, 295, 6), 6):
            copy[at] = f"edit{at}"
        rows += [row(i, " ".join(words))[:5], row(1000 + i, " ".join(copy))[:5]]
    for r in rows:
        w = r[1].split()
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = [len(sets[i] & sets[1000 + i]) / len(sets[i] | sets[1000 + i]) for i in range(60)]
    assert all(0.8 <= x < 0.85 for x in alike)
    kept = corpus_pipeline.no_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(60))
