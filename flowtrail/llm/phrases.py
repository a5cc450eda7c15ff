"""Phrase collocations by direct-address tiling of ranked ids.

Texts become blocks of word codes. Words are counted by hash buckets, and a block's codes are
replaced by the numbers of the frequent ones. Two frequent units side by side, each of m words and sharing m - 1 of
them, are a pair that stands for a phrase of m + 1 words. Within a block, units are ranked
by frequency, so that pairs fall into square tiles whose first ones hold
nearly everything: a crowded tile is counted by ``bincount`` over all its cells, the pairs of
the others as sorted coordinates. Sorted and packed by hash buckets of bounded size, the
counts of all blocks meet; a bucket adds them up, numbers its frequent pairs and hands every
block the numbers of the pairs that it holds. They are the units of the next round, and ranked in turn.

A block only ever meets the ranks of its own units, in a shuffle by block. Nothing that grows
with the corpus is sent to the driver or to all tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrail.operators.queue import global_rank
from flowtrail.session import release, stage

LONGEST, LEAST, TOP = 5, 100, 2000
NO_LANG = "und"
#: Words of a block. Its codes take 8 bytes each.
BLOCK_WORDS = 1 << 20
#: Side of a tile, and how many pairs make counting all its cells worth while.
SIDE, CROWDED = 1024, 1 << 16
#: Words of the corpus for each bucket of pairs, which holds no more pairs than that.
BUCKET_WORDS = 1 << 21
#: A frequent unit is first known by its bucket and, in so many bits, its place there.
PLACE_BITS = 22
#: Cuts pieces at these, and words at blanks and tabs.
STOPS = b".,;:!?\n\x0b\x0c\r"
CLEAN = bytes(10 if i in STOPS else 32 if i == 9 else i for i in range(256))
CODEC = "zstd"
BLOCK = "block long, lang string, size long, codes binary"


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<i8"), codec=CODEC, asbytes=True)


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * 8, codec=CODEC, asbytes=True), "<i8")


class Codes(dict):
    """Codes of words in the order in which they come, 0 for the end of a piece."""

    def __init__(self):
        self[b"\n"] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def slices(data: bytes, limit: int):
    """A text in parts of about ``limit`` bytes that end at stops."""
    at = 0
    while len(data) - at > limit:
        stop = data.find(b"\n", at + limit)
        if stop < 0:
            break
        yield data[at : stop + 1]
        at = stop + 1
    yield data[at:]


def blocker(block_words: int):
    """Blocks of codes (one language each), with their words and how often each comes."""

    def run(batches):
        block = TaskContext.get().partitionId() << 33
        held: dict[str, tuple[Codes, list[np.ndarray]]] = {}
        total = 0

        def blocks():
            nonlocal block
            for lang, (codes, parts) in held.items():
                flat = np.concatenate(parts)
                counts = np.bincount(flat, minlength=len(codes))
                words = [w.decode("utf-8", "replace") for w in codes][1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.array([lang]), pa.array([len(flat)]), pa.array([packed(flat)], pa.binary()),
                     pa.array([words], pa.list_(pa.string())), pa.array([counts[1:]], pa.list_(pa.int64()))],
                    ["block", "lang", "size", "codes", "words", "counts"],
                )
                block += 1
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "replace").lower().translate(CLEAN)
                for part in slices(data, 8 * block_words):
                    words = [w for w in part.replace(b"\n", b" \n ").split(b" ") if w]
                    if not words:
                        continue
                    codes, parts = held.setdefault(lang, (Codes(), []))
                    words.append(b"\n")
                    parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                    total += len(words)
                    if total >= block_words:
                        yield from blocks()
                        total = 0
        yield from blocks()

    return run


def adjacent(units: np.ndarray) -> np.ndarray:
    """Where a unit stands beside another one."""
    return np.flatnonzero((units[:-1] >= 0) & (units[1:] >= 0))


def counted(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of units side by side, and how often each comes."""
    at = adjacent(units)
    if not len(at):
        return units[:0], units[:0], units[:0]
    # Numbers by how often a unit comes in the block, the commonest first.
    known, often = np.unique(units, return_counts=True)
    often[known < 0] = 0
    order = np.argsort(-often, kind="stable")
    number = np.empty(len(known), np.int32)
    number[order] = np.arange(len(known), dtype=np.int32)
    ranks = known[order]
    across = -(-len(ranks) // SIDE)
    place = number[np.searchsorted(known, units)]
    i, j = place[at], place[at + 1]
    tile = (i // SIDE) * np.int32(across) + j // SIDE
    # At most len(at) / CROWDED tiles are crowded.
    tiles, size = np.unique(tile, return_counts=True)
    found, rest = [], np.ones(len(at), bool)
    for t in tiles[size >= CROWDED]:
        own = tile == t
        rest &= ~own
        cells = np.bincount((i[own] % SIDE) * SIDE + j[own] % SIDE, minlength=SIDE * SIDE)
        full = np.flatnonzero(cells)
        found.append(((t // across) * SIDE + full // SIDE, (t % across) * SIDE + full % SIDE, cells[full]))
    keys, n = np.unique(i[rest].astype(np.int64) * len(ranks) + j[rest], return_counts=True)
    found.append((keys // len(ranks), keys % len(ranks), n))
    i, j, n = (np.concatenate(x) for x in zip(*found))
    return ranks[i], ranks[j], n.astype(np.int64)


def sealed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, the first one ascending, packed."""
    first, *rest = columns
    return pa.compress(np.concatenate([np.diff(first, prepend=0), *rest]).astype("<i8"), codec=CODEC, asbytes=True)


def opened(data, size: int, columns: int = 3) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(data, columns * size * 8, codec=CODEC, asbytes=True), "<i8").reshape(columns, size).copy()
    np.cumsum(flat[0], out=flat[0])
    return flat


def bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def pair_counter(buckets: int):
    """Counts of the pairs of every block, packed by bucket."""

    def run(batches):
        for batch in batches:
            for block, size, codes in zip(batch.column("block").to_pylist(), batch.column("size").to_pylist(), batch.column("codes")):
                left, right, n = counted(unpacked(codes.as_buffer(), size))
                bucket = bucket_of(left, right, buckets)
                order = np.lexsort((right, left, bucket))
                left, right, n, bucket = left[order], right[order], n[order], bucket[order]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(at[1:], len(bucket))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[at]), pa.array(np.full(len(at), block)), pa.array(ends - at),
                         pa.array([sealed(left[i:j], right[i:j], n[i:j]) for i, j in zip(at, ends)], pa.binary())],
                        ["bucket", "block", "size", "data"],
                    )

    return run


def pair_summer(least: int, placed: bool):
    """Frequent pairs of a bucket (block -1) and, if ``placed``, those of every block with their ranks."""

    def run(rows: pa.Table) -> pa.Table:
        bucket, blocks = rows["bucket"][0].as_py(), rows["block"].to_pylist()
        parts = [opened(d.as_buffer(), n) for d, n in zip(rows["data"], rows["size"].to_pylist())]
        left, right, n = np.concatenate(parts, axis=1)
        ends = np.cumsum([p.shape[1] for p in parts])
        del parts
        lefts, i = np.unique(left, return_inverse=True)
        rights, j = np.unique(right, return_inverse=True)
        keys, place = np.unique(i * len(rights) + j, return_inverse=True)
        f = np.bincount(place, n).astype(np.int64)
        rank = ranked(f, least, bucket)
        often = np.flatnonzero(rank >= 0)
        out = [(-1, int(rank[k]), int(a), int(b), int(f[k]), 0, None) for k, a, b in
               zip(often, lefts[keys[often] // len(rights)], rights[keys[often] % len(rights)])]
        if placed:
            mine = rank[place]
            for block, start, end in zip(blocks, [0, *ends], ends):
                held = start + np.flatnonzero(mine[start:end] >= 0)
                if len(held):
                    out.append((block, 0, 0, 0, 0, len(held), sealed(left[held], right[held], mine[held])))
        return summed(out, ["block", "id", "left", "right", "f", "size", "data"], [pa.int64()] * 6 + [pa.binary()])

    return run


def block_table(rows: list[tuple]) -> pa.Table:
    block, lang, size, codes = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"block": pa.array(block, pa.int64()), "lang": pa.array(lang, pa.string()),
                     "size": pa.array(size, pa.int64()), "codes": pa.array(codes, pa.binary())})


def word_counter(buckets: int):
    """Words of every block with their codes and counts, packed by bucket."""

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=CODEC)
        for batch in batches:
            for k in range(batch.num_rows):
                words = batch.column("words")[k].values
                counts = batch.column("counts")[k].values
                lang = batch.column("lang")[k].as_py()
                bucket = np.fromiter((zlib.crc32(w.as_buffer()) for w in words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                for i, j in zip(at, np.append(at[1:], len(order))):
                    own = pa.array(order[i:j])
                    part = pa.record_batch({"word": words.take(own), "n": counts.take(own), "code": pa.array(order[i:j] + 1)})
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket[order[i]]]), pa.array([batch.column("block")[k].as_py()]), pa.array([lang]),
                         pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "block", "lang", "data"],
                    )

    return run


def word_summer(least: int):
    """Frequent words of a bucket (block -1), and those of every block: their codes and ranks."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        parts = [pa.ipc.open_stream(d.as_buffer()).read_all() for d in rows["data"]]
        whole = pa.concat_tables([p.append_column("lang", pa.array([x] * len(p), pa.string())) for p, x in zip(parts, rows["lang"].to_pylist())])
        ends = np.cumsum([len(p) for p in parts])
        # No word holds a line break, so the last one parts language and word.
        keys = pc.binary_join_element_wise(whole["lang"], whole["word"], "\n").combine_chunks().dictionary_encode()
        place = keys.indices.to_numpy()
        f = np.bincount(place, whole["n"].to_numpy()).astype(np.int64)
        rank = ranked(f, least, bucket)
        often = np.flatnonzero(rank >= 0)
        names = keys.dictionary.take(pa.array(often)).to_pylist()
        out = [(-1, int(rank[k]), *name.rsplit("\n", 1), int(f[k]), 0, None) for k, name in zip(often, names)]
        code, mine = whole["code"].to_numpy(), rank[place]
        for block, start, end in zip(rows["block"].to_pylist(), [0, *ends], ends):
            held = start + np.flatnonzero(mine[start:end] >= 0)
            if len(held):
                out.append((block, 0, None, None, 0, len(held), sealed(code[held], mine[held])))
        return summed(out, ["block", "id", "lang", "word", "f", "size", "data"],
                      [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()])

    return run


def ranked(f: np.ndarray, least: int, bucket: int) -> np.ndarray:
    """Bucket and place, from 0, of everything that is frequent; -1 for the rest."""
    rank = np.full(len(f), -1)
    often = np.flatnonzero(f >= least)
    rank[often] = (bucket << PLACE_BITS) + np.arange(len(often))
    return rank


def dense(rank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of all buckets in one row of numbers, which pack well."""
    return offsets[rank >> PLACE_BITS] + (rank & ((1 << PLACE_BITS) - 1))


def numbered(found: DataFrame, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """The frequent units of all buckets with dense ranks, and where each bucket's ranks start.

    The driver holds one number for each bucket, that is for each BUCKET_WORDS words.
    """
    bucket = F.shiftright("id", PLACE_BITS)
    own = found.where("block < 0")
    sizes = np.zeros(buckets, np.int64)
    for b, n in own.groupBy(bucket.alias("b")).count().collect():
        sizes[b] = n
    offsets = np.cumsum(sizes) - sizes
    starts = found.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(offsets)], "b long, start long")
    placed = own.withColumn("b", bucket).join(starts, "b")
    return placed.withColumn("rank", F.col("start") + F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("b", "start", "id"), offsets


def summed(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    return pa.table({c: pa.array(x, t) for c, x, t in zip(names, zip(*rows) if rows else [()] * len(names), kinds)})


def word_ranker(offsets: np.ndarray, blocks: pa.Table, ranks: pa.Table) -> pa.Table:
    """Ranks in place of codes; -1 for infrequent words and ends of pieces."""
    out = []
    parts = [opened(d.as_buffer(), n, 2) for d, n in zip(ranks["data"], ranks["n"].to_pylist())]
    code, rank = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int64)
    for row in blocks.to_pylist():
        codes = unpacked(row["codes"], row["size"])
        of = np.full(int(codes.max(initial=0)) + 1, -1)
        of[code] = dense(rank, offsets)
        out.append((row["block"], row["lang"], row["size"], packed(of[codes])))
    return block_table(out)


def pair_ranker(offsets: np.ndarray, blocks: pa.Table, ranks: pa.Table) -> pa.Table:
    """Ranks of pairs in place of those of their left units; -1 where a pair is not frequent."""
    out = []
    parts = [opened(d.as_buffer(), n) for d, n in zip(ranks["data"], ranks["n"].to_pylist())]
    left, right, rank = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)
    for row in blocks.to_pylist():
        units = unpacked(row["codes"], row["size"])
        known, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        keys = place[: len(left)] * len(known) + place[len(left) :]
        order = np.argsort(keys)
        at = adjacent(units)
        i, j = np.searchsorted(known, units[at]), np.searchsorted(known, units[at + 1])
        fine = (i < len(known)) & (j < len(known))
        at, i, j = at[fine], i[fine], j[fine]
        fine = (known[i] == units[at]) & (known[j] == units[at + 1])
        at, want = at[fine], i[fine] * len(known) + j[fine]
        found = np.minimum(np.searchsorted(keys[order], want), len(keys) - 1)
        fine = keys[order][found] == want
        made = np.full(len(units), -1)
        made[at[fine]] = dense(rank[order[found[fine]]], offsets)
        out.append((row["block"], row["lang"], row["size"], packed(made)))
    return block_table(out)


def reranked(blocks: DataFrame, ranks: DataFrame, ranker, offsets: np.ndarray) -> DataFrame:
    """The blocks with new ranks; a block that holds no frequent unit goes."""
    ranks = ranks.withColumnRenamed("block", "of_block")

    def apply(held: pa.Table, found: pa.Table) -> pa.Table:
        return ranker(offsets, held, found)

    return blocks.groupBy("block").cogroup(ranks.groupBy("of_block")).applyInArrow(apply, BLOCK).where("size > 0")


def lowest_cut() -> Column:
    """The cut of smallest floor(1000 a n / (l r)), then smallest k, in whole numbers of up to 38 digits (counts below 10^15)."""
    whole = "cast({} as decimal(15,0))".format
    return F.expr(
        f"""array_min(transform(arrays_zip(heads, tails), (x, k) -> struct(
              (1000bd * {whole("a")} * {whole("n")}) div ({whole("x.heads")} * {whole("x.tails")}) as score, k as k,
              x.heads as l, x.tails as r)))"""
    )


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; null texts count as empty, null languages as ``und``. Words are
    what blanks and tabs part within pieces between stops, A-Z in lower case. A phrase has 2 to
    ``longest`` words and comes ``a`` >= ``least`` times. It is cut after its first k words where
    floor(1000 a n / (l r)) is smallest (then the smallest k); l and r are counts of both
    parts, n the language's words. Phrases that never come without one and the same
    longer phrase around them are dropped. Order is score and a descending, then phrase. Repeated rows count
    each time. Empty tables and tables without such phrases give no rows. Other columns do not matter.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    blocks = stage(rows.mapInArrow(blocker(block_words), f"{BLOCK}, words array<string>, counts array<long>"), "phrase_blocks")
    totals = blocks.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = stage(totals.groupBy("lang").agg(F.sum("n").alias("n")), "phrase_words")
    buckets = max(1, -(-(totals.agg(F.sum("n")).head()[0] or 0) // BUCKET_WORDS))
    words = blocks.select("block", "lang", "words", "counts").mapInArrow(word_counter(buckets), "bucket long, block long, lang string, data binary")
    found = words.groupBy("bucket").applyInArrow(
        word_summer(least), "block long, id long, lang string, word string, f long, size long, data binary"
    )
    found = stage(found, "phrase_words")
    # heads and tails: counts of the first 1, 2, ... words, and of what is left after them.
    none = F.array().cast("array<long>")
    units, offsets = numbered(found, buckets)
    units = stage(units.select("rank", "lang", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails")), "phrase_units")
    ranks = found.where("block >= 0").select("block", F.col("size").alias("n"), "data")
    old, blocks = blocks, stage(reranked(blocks.select("block", "lang", "size", "codes"), ranks, word_ranker, offsets), "phrase_blocks")
    release(old)

    levels = []
    for m in range(2, longest + 1):
        counts = blocks.select("block", "size", "codes").mapInArrow(pair_counter(buckets), "bucket long, block long, size long, data binary")
        found = counts.groupBy("bucket").applyInArrow(
            pair_summer(least, m < longest), "block long, id long, left long, right long, f long, size long, data binary"
        )
        found = stage(found, "phrase_pairs")
        pairs, offsets = numbered(found, buckets)
        a = units.select(F.col("rank").alias("left"), "lang", F.col("phrase").alias("_a"), F.col("f").alias("_fa"), "heads")
        b = units.select(F.col("rank").alias("right"), F.col("phrase").alias("_b"), F.col("f").alias("_fb"), "tails")
        units = stage(
            pairs.select("rank", "left", "right", "f").join(a, "left").join(b, "right").select(
                "rank", "lang", F.concat_ws(" ", "_a", F.substring_index("_b", " ", -1)).alias("phrase"), "f",
                F.concat("heads", F.array("_fa")).alias("heads"), F.concat(F.array("_fb"), "tails").alias("tails"),
                "left", "right", "_fa", "_fb",
            ),
            "phrase_units",
        )
        levels.append(units)
        if m < longest:
            ranks = found.where("block >= 0").select("block", F.col("size").alias("n"), "data")
            old, blocks = blocks, stage(reranked(blocks, ranks, pair_ranker, offsets), "phrase_blocks")
            release(old)
        release(found)

    kept = []
    for unit, longer in zip(levels, [*levels[1:], None]):
        if longer is not None:
            # A longer phrase that comes as often as this one holds one of the next length that does.
            inside = longer.where("f = _fa").select(F.col("left").alias("rank"))
            inside = inside.unionByName(longer.where("f = _fb").select(F.col("right").alias("rank"))).distinct()
            unit = unit.join(inside, "rank", "left_anti")
        kept.append(unit.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionByName(more)
    few = F.broadcast(totals) if totals.count() <= 10_000 else totals
    best = every.join(few, "lang").withColumn("b", lowest_cut())
    # Ranked in one order of all languages by ranges, so a language that holds most phrases is no task of its own.
    order = [F.asc("lang"), F.desc("b.score"), F.desc("a"), F.asc("phrase")]
    ranked = stage(global_rank(best.select("lang", "phrase", "a", "n", "b"), order, "phrase_order", "at"), "phrase_ranks")
    first = ranked.groupBy("lang").agg(F.min("at").alias("first"))
    return (
        ranked.join(first, "lang").withColumn("rank", F.col("at") - F.col("first") + 1)
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")
    )
