"""Quality classifier: supervised subword embeddings.

Every word and all of its character n-grams, however long the word, have learned vectors in a hashed table. A document is
the mean of all of them, a softmax layer gives the class. It is trained by stochastic
gradient descent in numpy on a bounded sample of labelled documents and applied in batches
on the executors. As softmax over two classes only needs one number per vector, what is
sent to the executors is one float per bucket (1 MB), and a word's sum is computed once per
task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIM = 6
NGRAMS = (3, 4)
#: Most labelled rows used to fit, taken in the order of a hash of their id.
MAX_FIT_ROWS = 3000
EPOCHS, BATCH, RATE = 6, 32, 2.0
CUT = 0.3
# Words of their own: a word that repeats the one before, a line that repeats an earlier one.
SAME_WORD, SAME_LINE = "\x00word", "\x00line"
MOST_CACHED, SLICE_ROWS = 200_000, 512
#: A word of more characters is hashed in slices and, in scoring, summed without being kept.
LONG_WORD, SLICE = 256, 65_536


def buckets(word: str) -> list[int]:
    """Hashed ids of a word and its character n-grams."""
    digest = xxhash.xxh3_64_intdigest
    ids = [digest(word.encode("utf-8", "surrogatepass")) % BUCKETS]
    if word[0] != "\x00":
        marked = f"<{word}>"
        ids += [digest(marked[i : i + n].encode("utf-8", "surrogatepass"), seed=1) % BUCKETS
                for n in NGRAMS for i in range(len(marked) - n + 1)]
    return ids


def long_buckets(word: str):
    """The ids of ``buckets`` for a long word, as arrays of bounded size."""
    yield np.array([xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS], np.int32)
    marked, digest = f"<{word}>", xxhash.xxh3_64_intdigest
    for n in NGRAMS:
        count = len(marked) - n + 1
        for at in range(0, count, SLICE):
            part = marked[at : min(at + SLICE, count) + n - 1]
            found = (digest(part[i : i + n].encode("utf-8", "surrogatepass"), seed=1) % BUCKETS
                     for i in range(len(part) - n + 1))
            yield np.fromiter(found, np.int32, len(part) - n + 1)


def units(text: str | None) -> list[str]:
    """Words of a text, with the marks of repetition."""
    words = (text or "").split()
    out = words + [SAME_WORD] * sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return out + [SAME_LINE] * (len(lines) - len(set(lines)))


class Words(dict):
    """Word -> number; calls ``made`` for a word that is new."""

    def __init__(self, made):
        self.made = made

    def __missing__(self, word):
        self[word] = n = len(self)
        self.made(word)
        return n


def numbers(words: Words, text: str | None) -> np.ndarray:
    found = units(text)
    return np.fromiter(map(words.__getitem__, found), np.int64, len(found))


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Learns vectors and softmax; returns the log-odds of class 1 per bucket, and their bias."""
    rng = np.random.default_rng(seed)
    features: list[np.ndarray] = []
    words = Words(lambda w: features.append(np.concatenate(list(long_buckets(w))) if len(w) > LONG_WORD else np.array(buckets(w), np.int32)))
    docs = [np.unique(numbers(words, t), return_counts=True) for t in texts]
    length = np.array([len(f) for f in features] or [0])
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.concatenate(features or [np.empty(0, np.int32)])
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    labels = np.asarray(labels, np.int64)
    steps, done = max(1, EPOCHS * -(-len(docs) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            word = np.concatenate([docs[i][0] for i in batch])
            count = np.concatenate([docs[i][1] for i in batch]).astype(float)
            doc = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            n = length[word]
            total = np.maximum(np.bincount(doc, count * n, len(batch)), 1)
            ends = np.cumsum(n)
            ids = flat[np.repeat(start[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            share = np.repeat(count / total[doc], n)
            owner = np.repeat(doc, n)
            mean = np.stack([np.bincount(owner, share * vectors[ids, d], len(batch)) for d in range(DIM)], axis=1)
            logits = mean @ layer.T + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ layer
            layer -= rate * p.T @ mean / len(batch)
            bias -= 0.1 * rate * p.mean(axis=0)
            touched, place = np.unique(ids, return_inverse=True)
            step = np.stack([np.bincount(place, share * back[owner, d], len(touched)) for d in range(DIM)], axis=1)
            vectors[touched] -= rate * step
            done += 1
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(odds: np.ndarray, bias: float, text: str, cut: float | None = None):
    """Adds the score of column ``text``; with ``cut``, returns rows of at least this score, unchanged.

    Texts are read ``SLICE_ROWS`` at a time, and words are forgotten when there are too many of them.
    """

    def score(batches):
        sums, sizes = [], []

        def made(word):
            ids = buckets(word)
            sums.append(float(odds[ids].sum()))
            sizes.append(len(ids))

        words = Words(made)

        def scores(texts):
            docs, more_s, more_n = [], [], []
            for t in texts:
                found = units(t)
                long = [w for w in found if len(w) > LONG_WORD]
                if long:
                    found = [w for w in found if len(w) <= LONG_WORD]
                more = [(float(odds[ids].sum()), len(ids)) for w in long for ids in long_buckets(w)]
                more_s.append(sum(x for x, _ in more))
                more_n.append(sum(n for _, n in more))
                docs.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
            s, n = np.array(sums or [0.0]), np.array(sizes or [0])
            logit = np.array([
                bias + ((s[d].sum() + a) / (n[d].sum() + k) if len(d) or k else 0.0)
                for d, a, k in zip(docs, more_s, more_n)
            ])
            if len(words) > MOST_CACHED:
                words.clear(), sums.clear(), sizes.clear()
            return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                found = scores(rows.column(text).to_pylist())
                if cut is not None:
                    yield rows.filter(pa.array(found >= cut))
                else:
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return score


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> tuple[np.ndarray, float]:
    """Fits on at most ``max_rows`` labelled documents outside the held-out rows."""
    picked = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .select("doc_id", F.col("quality").alias("_quality"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_quality")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "_quality", "text"], kind="stable")
    return fit(rows["text"].tolist(), rows["_quality"].tolist())


def scored(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``score`` is the probability of quality 1 from the text alone. Null, empty and blank
    texts get the score of the bias. Without labelled rows every score is one half or so,
    set by the untrained table. Null ids are never learned from. Repeated rows get equal
    scores; labels that contradict each other are all learned. An empty table gives no rows.
    Columns not named here are left out.
    """
    odds, bias = train(docs, labels, max_rows)
    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(scorer(odds, bias, "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted")
    )


def filtered(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they were.

    Null, empty and blank texts get the score of the bias and stay or go with it. Null ids and
    repeated rows stay rows of their own; an empty table gives none. Column names may clash.
    """
    odds, bias = train(docs, labels, max_rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    keep = scorer(odds, bias, names[docs.columns.index("text")], cut)
    return docs.toDF(*names).mapInArrow(keep, kinds).toDF(*docs.columns)
