"""Packing documents into token windows by multiway differencing (Karmarkar and Karp).

A document's ids are cut into full windows, which are sequences already and move nowhere, and
a rest in parts of at most ``PART`` ids. Parts are dealt into groups of bounded size, and each
group is partitioned into windows at once: every part starts as a partition of its own with
one filled window, and the two partitions whose windows differ most are merged, the fullest
windows of one with the emptiest of the other, until one partition is left. Its windows are
nearly equal. If the fullest does not fit, the group is tried again with one more window.
"""

from __future__ import annotations

import heapq
import os
import string
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowtrail.session import stage

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
CAPACITY = 2048
#: Id after the last one of a document.
END_ID = 1
END = struct.pack("<I", END_ID)
#: Longest part of a rest. Whole rests, three to a window, would leave 4.3 % of padding, these 0.5 %.
PART = 512
#: Windows that a group fills, on average. A larger group loses less to its last window and takes longer.
GROUP_WINDOWS = 128
#: Parts shorter than the first go bundled, so many ids together, so that a group has a bounded number of items.
SHORT, BUNDLE = 32, 64
#: Words whose ids a task keeps, and the longest such word in bytes.
MOST_KEPT, LONGEST_KEPT = 600_000, 64
#: Punctuation of ASCII: after letters, it is a token of its own up to the end of the word.
STOPS = string.punctuation.encode()
#: Rows written at a time.
ROWS = 1000
COLUMNS = "piece long, doc_id long, start long, length long, doc_tokens long, ids binary"


#: How the vocabulary writes bytes: printable ones as themselves, the others as characters from 256 on, in order.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def lowered(word: str) -> bytes:
    """A word of letters of the first two Latin blocks in lower case; nothing for other words.

    These letters are composed already, and each is lowered by itself.
    """
    if not word.isalpha() or max(word) > "\u017f":
        return b""
    low = word.lower()
    return low.encode() if low.isalpha() else b""


class Ids(dict):
    """Ids of words as little-endian 32-bit numbers, asked of the tokenizer when they are new.

    No token of this tokenizer reaches across a blank, nor from letters into punctuation. So a
    word's ids are kept for later texts, and a word of plain letters, with or without stops
    after it, is put together from both parts without the tokenizer's normalisation, which
    would only lower the letters.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize = tokenizer, tokenizer.model.tokenize
        self.special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, word: bytes) -> bytes:
        """Ids of lower-case letters."""
        shown = word.decode() if word.isascii() else word.decode("latin-1").translate(AS_CHARS)
        ids = [t.id for t in self.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            ids = self.letters(word)
        else:
            core = word.rstrip(STOPS)
            low = core.lower() if core.isalpha() else lowered(core.decode())
            if not low:
                ids = self.encoded(word.decode())
            elif low == word:
                ids = self.letters(word)
            else:
                ids = self[low] + self[word[len(core) :]] if len(core) < len(word) else self[low]
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        """Ids of a text, put together from those of its words."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.encoded(text)
        if len(self) > MOST_KEPT:
            self.clear()
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))


@lru_cache(1)
def read(tokenizer_json: str):
    """The tokenizer, made once by each Python process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def cutter(tokenizer_json: str, capacity: int, part: int):
    """Encodes texts and cuts their ids into windows and the parts of a rest."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known, piece, rows = Ids(read(tokenizer_json)), TaskContext.get().partitionId() << 33, []
        schema = pa.schema([("piece", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("ids", pa.binary())])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part_rows = batch.slice(at, ROWS)
                for doc_id, text in zip(part_rows.column("doc_id").to_pylist(), part_rows.column("text").to_pylist()):
                    ids = known.text(text) + END
                    size = len(ids) // 4
                    rest = size - size % capacity
                    starts = [*range(0, rest, capacity), *range(rest, size, part)]
                    for start, end in zip(starts, [*starts[1:], size]):
                        rows.append((piece, doc_id, start, end - start, size, ids[4 * start : 4 * end]))
                        piece += 1
                    if len(rows) >= ROWS:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return run


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size: multiway differencing into ``k`` windows.

    A partition is its windows' sums in ascending order, less the smallest one. Equal
    differences are merged in the order in which their partitions were made.
    """
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    heap: list = []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[-1] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    merges, made = [], n
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        # Window w of the merged partition is window order[w] of the left one.
        merges.append((made, a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-int(sums[-1]), made, sums))
        made += 1
    window = np.full(n, k - 1)
    # From the last merge back: where the windows of each partition end up.
    ends = {heap[0][1]: np.arange(k, dtype=np.int32)}
    for node, a, b, order in reversed(merges):
        at = ends.pop(node)
        of_left = np.empty(k, np.int32)
        of_left[order] = at
        for child, place in ((a, of_left), (b, of_left[::-1])):
            if child < n:
                window[child] = place[-1]
            else:
                ends[child] = place
    return window


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size, so that no window holds more than ``capacity``."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differenced(sizes, k)
        if np.bincount(found, sizes, k).max(initial=0) <= capacity:
            return found
        k += 1


def bundled(sizes: np.ndarray, short: int = SHORT, bundle: int = BUNDLE) -> np.ndarray:
    """The item, from 0, that each size belongs to: its own, or for short ones one that they share."""
    small = sizes < short
    shared = (np.cumsum(np.where(small, sizes, 0)) - 1) // bundle
    return np.unique(np.where(small, shared, -1 - np.arange(len(sizes))), return_inverse=True)[1]


def placer(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["piece"].to_numpy(), -rows["length"].to_numpy()))
        rows = rows.take(pa.array(order))
        sizes = rows["length"].to_numpy()
        item = bundled(sizes) if capacity > 2 * BUNDLE else np.arange(len(sizes))
        window = windows(np.bincount(item, sizes).astype(np.int64), capacity)[item]
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.diff(window[order], prepend=-1))
        counts = np.diff(np.append(first, len(order)))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], counts)
        # Even numbers; full windows have odd ones.
        sequence = (rows["group"].to_numpy().astype(np.int64) << 33) + 2 * window
        rows = rows.drop_columns(["group", "piece"])
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def read_tokenizer(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def cut(docs: DataFrame, tokenizer_json: str | None = None, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """Pieces of the documents of ``docs`` (doc_id, text), written once.

    Returns piece (its number), doc_id, start, length, doc_tokens, ids (binary, unsigned
    32-bit little-endian). Ids are those of the tokenizer without special tokens of its own,
    then ``END_ID``; a null or empty text is that id alone. The tokenizer reads special tokens
    that are spelled out in a text as such. All ids of a document lie in its pieces once. Null ids are
    kept; repeated rows are cut each for itself. An empty table gives no rows. Other columns are left out.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cutter(tokenizer_json or read_tokenizer(), capacity, min(part, capacity)), COLUMNS
    )
    return stage(made, "token_pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Pieces (piece, length and any other columns) with sequence_id and offset in place of ``piece``.

    A sequence holds at most ``capacity`` ids, its pieces follow each other from 0. Columns
    besides ``length`` travel along, so leave out ids where places are enough. An empty table
    gives no rows. Which parts share a group depends on how Spark dealt the rows.
    """
    full, rest = F.col("length") == capacity, F.col("length") < capacity
    tokens = pieces.where(rest).agg(F.sum("length")).head()[0] or 0
    groups = max(1, round(tokens / (group_windows * capacity)))
    dealt = pieces.where(rest).withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    kept = StructType([f for f in pieces.schema.fields if f.name != "piece"])
    out = StructType([*kept.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    whole = pieces.where(full).withColumns({"sequence_id": 2 * F.col("piece") + 1, "offset": F.lit(0).cast("long")})
    return dealt.groupBy("group").applyInArrow(placer(capacity), out).unionByName(whole.drop("piece"))


def pack(
    docs: DataFrame, tokenizer_json: str | None = None, capacity: int = CAPACITY, part: int = PART,
    group_windows: int = GROUP_WINDOWS,
) -> DataFrame:
    """``cut`` and ``place``: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return place(cut(docs, tokenizer_json, capacity, part), capacity, group_windows)


def padded_length(tokens):
    """Length a sequence of this many tokens is padded to: ``CAPACITY``, or its own if that is a power of two."""
    return F.when(F.bit_count(tokens) == 1, tokens).otherwise(F.lit(CAPACITY))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tokens and ids (binary) of every sequence of ``pack``; padding is left to the reader."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return whole.select("sequence_id", "tokens", joined.alias("ids"))
