"""Repeated passages by sparse suffix arrays.

Suffixes are kept only at minimiser positions: of every ``SPAN`` places in a row the one
with the smallest hashed k-gram. Which places those are depends on the words alone, so a
passage repeated elsewhere keeps the same ones, and any ``MIN_WORDS`` repeated words hold a
kept suffix whose next ``RUN`` words are inside. Kept suffixes that share those words with
another document are sorted by the words that follow; neighbours are compared and the match
extended to both sides. Where a neighbour does not settle it, every way to place the
``MIN_WORDS`` words around the suffix is compared among all suffixes of the same run, so no
repeated passage is lost.

Runs shared by more than ``HOT`` suffixes are not brought together: their placements are
counted by partial aggregation instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtrail.llm.minhash import U, mixed
from flowtrail.session import stage

MIN_WORDS = 50
GRAM = 8
SPAN = 21
RUN = MIN_WORDS + 1 - SPAN
SIDE = MIN_WORDS - RUN  # words looked at before a suffix and after its run
HOT = 100_000
FACTOR = U(0x9E3779B97F4A7C15)


def hashed_words(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def runs(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place."""
    total = np.zeros(len(at), U)
    for k in range(n):
        total = total * FACTOR + words[at + k]
    return mixed(total)


def kept_places(words: np.ndarray) -> np.ndarray:
    """Minimiser places with a whole run after them."""
    if len(words) < MIN_WORDS:
        return np.empty(0, np.int64)
    grams = runs(words, np.arange(len(words) - GRAM + 1), GRAM)
    least = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(axis=1)
    places = np.unique(least + np.arange(len(least)))
    return places[places + RUN <= len(words)]


def keys_of(batches):
    for batch in batches:
        ids, keys = [], []
        for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            words = hashed_words(text if isinstance(text, str) else None)
            at = kept_places(words)
            if len(at):
                keys.append(np.unique(runs(words, at, RUN)))
                ids.append(np.full(len(keys[-1]), doc_id))
        if ids:
            yield pd.DataFrame({"doc_id": np.concatenate(ids).astype(np.int64), "key": np.concatenate(keys).view(np.int64)})


def sides(batches):
    """The kept suffixes of a document whose runs are in ``keys``: words before (nearest first) and after.

    Where a text repeats itself, near suffixes in a row can look alike; they become one row
    that says in ``extent`` how much further on the last of them is.
    """
    pad = SIDE
    for batch in batches:
        out = []
        for doc_id, text, wanted in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["keys"].tolist()):
            words = hashed_words(text)
            at = kept_places(words)
            key = runs(words, at, RUN).view(np.int64)
            chosen = np.isin(key, np.asarray(wanted))
            at, key = at[chosen], key[chosen]
            # Words outside the document are 0, which no word is.
            short = np.concatenate([np.zeros(pad, np.uint32), (words >> U(32)).astype(np.uint32) | np.uint32(1), np.zeros(pad, np.uint32)])
            before = short[at[:, None] + pad - 1 - np.arange(SIDE)]
            after = short[at[:, None] + pad + RUN + np.arange(SIDE)]
            alike = (key[1:] == key[:-1]) & (before[1:] == before[:-1]).all(axis=1) & (after[1:] == after[:-1]).all(axis=1)
            first = np.flatnonzero(np.append(True, ~(alike & (np.diff(at) <= RUN)))[: len(at)])
            last = np.append(first[1:] - 1, len(at) - 1)[: len(first)]
            extent, at, key, before, after = at[last] - at[first], at[first], key[first], before[first], after[first]
            out.append(pd.DataFrame({
                "doc_id": doc_id, "place": at.astype(np.int32), "extent": extent.astype(np.int32), "key": key,
                "after": [x.astype(">u4").tobytes() for x in after], "before": [x.astype(">u4").tobytes() for x in before],
            }))
        if out:
            yield pd.concat(out)


def words_of(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), ">u4").reshape(n, SIDE).astype(np.uint32)


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the rows of a and b share from the start."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)


def placements(key: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the MIN_WORDS words that start k words before each suffix, for every k; and which exist."""
    left, right = np.zeros((SIDE + 1, len(key)), U), np.zeros((SIDE + 1, len(key)), U)
    for k in range(SIDE):
        left[k + 1] = mixed(left[k] * FACTOR + before[:, k])
        right[k + 1] = mixed(right[k] * FACTOR + after[:, k] + U(1))
    ks = np.arange(SIDE + 1)
    whole = mixed(key.view(U)[None] * FACTOR + left * U(0xD6E8FEB86659FD93) + right[::-1] + ks[:, None].astype(U))
    has_left = np.concatenate([np.ones((1, len(key)), bool), (before != 0).T.cumprod(axis=0).astype(bool)])
    has_right = np.concatenate([np.ones((1, len(key)), bool), (after != 0).T.cumprod(axis=0).astype(bool)])
    return whole, has_left & has_right[::-1]


def matches(part: pd.DataFrame) -> pd.DataFrame:
    """Repeated stretches around suffixes, from rows sorted by key, words after and words before."""
    n = len(part)
    key, doc, place = part["key"].to_numpy(), part["doc_id"].to_numpy(), part["place"].to_numpy()
    extent = part["extent"].to_numpy()
    after, before = words_of(part["after"], n), words_of(part["before"], n)
    start, end, other = [], [], []
    rows = []
    settled = np.zeros(n, bool)
    if n > 1:
        i = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] != doc[:-1]))
        right, left = shared(after[i], after[i + 1]), shared(before[i], before[i + 1])
        long = right + left + RUN >= MIN_WORDS
        i, right, left = i[long], right[long], left[long]
        for a, b in ((i, i + 1), (i + 1, i)):
            rows.append(a), start.append(place[a] - left), end.append(place[a] + extent[a] + RUN + right), other.append(doc[b])
            settled[a[(left == SIDE) & (right == SIDE)]] = True
    # Runs with a suffix that its neighbours did not settle in full.
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, int)
    if n:
        open_ = np.repeat(np.logical_or.reduceat(~settled, edges), np.diff([*edges, n]))
        at = np.flatnonzero(open_)
        if len(at):
            whole, exists = placements(key[at], before[at], after[at])
            for k in range(SIDE + 1):
                own = np.flatnonzero(exists[k])
                if not len(own):
                    continue
                order = own[np.lexsort((doc[at[own]], whole[k][own]))]
                h, d = whole[k][order], doc[at[order]]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                size = np.diff([*first, len(h)])
                low, high = np.repeat(d[first], size), np.repeat(d[first + size - 1], size)
                hit = low != high
                r = at[order[hit]]
                rows.append(r), start.append(place[r] - k), end.append(place[r] + extent[r] - k + MIN_WORDS)
                other.append(np.where(low[hit] == d[hit], high[hit], low[hit]))
    if not rows:
        return pd.DataFrame({"doc_id": [], "start": [], "end": [], "other": []})
    rows = np.concatenate(rows)
    return pd.DataFrame({"doc_id": doc[rows], "start": np.concatenate(start), "end": np.concatenate(end), "other": np.concatenate(other)})


def whole_runs(batches):
    """Matches of sorted rows; rows of one key are kept together across batches."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        key = batch["key"].to_numpy()
        cut = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]) if len(key) else 0
        if cut:
            yield matches(batch.iloc[:cut].reset_index(drop=True))
        rest = batch.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield matches(rest)


def every_placement(batches):
    for batch in batches:
        n = len(batch)
        whole, exists = placements(batch["key"].to_numpy(), words_of(batch["before"], n), words_of(batch["after"], n))
        k, row = np.nonzero(exists)
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].to_numpy()[row], "start": batch["place"].to_numpy()[row] - k, "extent": batch["extent"].to_numpy()[row], "h": whole[k, row].view(np.int64),
        })


def repeated_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Passages of at least MIN_WORDS words that stand in another document too.

    Words are parted by white space and compared as they are. Returns doc_id, start_word,
    end_word (exclusive), n_words, other_doc_id (the smallest id met for the first stretch
    of the passage): a row for each largest stretch of ``docs`` (doc_id, text) whose every
    word is in some repeated passage. Passages repeated in one document only are left out,
    and so are rows with a null id and texts that are null, empty or shorter; repeated rows
    count as one document. An empty table gives no rows. Columns not named here are left out.
    """
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = stage(docs.mapInPandas(keys_of, "doc_id long, key long"), "suffix_runs")
    found = (
        keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        .where("low < high").select("key", (F.col("n") > hot).alias("is_hot"))
    )
    found = stage(found, "repeated_runs")
    wanted = keys.join(found, "key").select("doc_id", "key", "is_hot")
    wanted = stage(
        wanted.groupBy("doc_id").agg(
            F.collect_set(F.when(~F.col("is_hot"), F.col("key"))).alias("keys"), F.collect_set(F.when(F.col("is_hot"), F.col("key"))).alias("hot_keys")
        ),
        "suffixes_wanted",
    )
    schema = "doc_id long, place int, extent int, key long, after binary, before binary"
    texts = docs.join(wanted, "doc_id")
    rows = texts.where(F.size("keys") > 0).select("doc_id", "text", "keys").mapInPandas(sides, schema)
    spans = (
        rows.repartition("key").sortWithinPartitions("key", "after", "before", "doc_id", "place")
        .mapInPandas(whole_runs, "doc_id long, start long, end long, other long")
    )
    if not found.where("is_hot").isEmpty():
        placed = texts.where(F.size("hot_keys") > 0).select("doc_id", "text", F.col("hot_keys").alias("keys")).mapInPandas(sides, schema)
        placed = stage(placed.mapInPandas(every_placement, "doc_id long, start long, extent long, h long"), "hot_placements")
        ends = stage(
            placed.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "hot_repeats"
        )
        spans = spans.unionByName(
            placed.join(ends, "h").select(
                "doc_id", "start", (F.col("start") + F.col("extent") + MIN_WORDS).alias("end"),
                F.when(F.col("low") == F.col("doc_id"), F.col("high")).otherwise(F.col("low")).alias("other"),
            )
        )
    spans = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    opens = F.col("start") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    return (
        spans.withColumn("part", opens.cast("int"))
        .withColumn("part", F.sum("part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "part")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min_by("other", F.struct("start", "end")).alias("other_doc_id"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
    )
