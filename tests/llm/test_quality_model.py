import random
import zlib

from tests.llm.helpers import frame, odd_rows, prose, row

from flowtrail.llm import quality_model


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(60, i) if good else " ".join(w.upper() + "!!" for w in prose(60, i).split())
        rows.append(row(i, text))
        labels.append((i, int(good), 0))
    labels += [(3, None, 1), (None, 1, 0), (99_999, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_model.scored(frame(spark, rows + odd_rows()), marks).collect()
    assert len(got) == len(rows) + len(odd_rows())
    truth = {i: q for i, q, _ in labels}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < 400]
    assert len(judged) > 40 and sum(r.predicted == truth[r.doc_id] for r in judged) / len(judged) > 0.97
    kept = quality_model.filtered(frame(spark, rows), marks)
    assert kept.columns == frame(spark, rows).columns and 200 < kept.count() < 320


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.scored(frame(spark, []), none).count() == 0
    got = quality_model.scored(frame(spark, [row(1, "some text"), row(2, None)]), none).collect()
    assert all(0 <= r.score <= 1 for r in got)


def test_fit_does_not_depend_on_labels_of_held_out_rows(spark):
    rows = [row(i, prose(20, i)) for i in range(60)]
    held = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    one = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    two = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (quality_model.scored(frame(spark, rows), x).select("doc_id", "score").collect() for x in (one, two))
    assert a == b


def test_whole_long_words_are_scored():
    import numpy as np
    import pyarrow as pa

    def score(odds, texts):
        batch = pa.record_batch({"doc_id": range(len(texts)), "text": texts})
        (got,) = quality_model.scorer(odds, 0.1, "text")([batch])
        return got.column("score").to_pylist()

    rng = random.Random(6)
    odds = np.random.default_rng(1).normal(0, 1, quality_model.BUCKETS).astype(np.float32)
    start = "".join(rng.choice("甲乙丙丁戊己庚辛壬癸") for _ in range(63))
    rests = ["子" * 500, "丑寅卯" * 300, "x" * 150_000, "y" * 40]
    # All of a word's n-grams count, those at the seams of slices too.
    want = []
    for rest in rests:
        ids = quality_model.buckets(start + rest)
        assert len(ids) == 2 * len(start + rest)
        want.append(1 / (1 + np.exp(-(0.1 + odds[ids].astype(float).sum() / len(ids)))))
    got = score(odds, [start + rest for rest in rests])
    assert np.allclose(got, want, atol=1e-4)
    # The hash of the whole word aside, what differs is after the first 63 characters.
    flat = odds.copy()
    for rest in rests:
        flat[quality_model.buckets(start + rest)[0]] = 0
    assert len({round(x, 6) for x in score(flat, [start + rest for rest in rests])}) == len(rests)
    long = [w for rest in rests if len(w := start + rest) > quality_model.LONG_WORD]
    for w in long:
        assert sorted(np.concatenate(list(quality_model.long_buckets(w))).tolist()) == sorted(quality_model.buckets(w))
