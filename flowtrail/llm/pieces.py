"""SentencePiece encoding and decoding as a relational lattice.

A text, with a blank in front, is cut into units wherever no piece of the table holds the two
characters that meet there: no piece reaches across such a place, so the best paths of the
units make up the best path of the text. Every distinct unit is encoded once: its substrings
of bounded length are joined with the piece table, what matches are the edges of a lattice,
edges are grouped by unit, and the best path is folded over the end positions. The few units
longer than that are folded whole where they occur. Characters without a piece become byte
pieces, so decoding gives the text back exactly.

Texts are shuffled once, packed by chunk; a chunk meets the encodings of just its own
units, so no table that grows with the corpus is broadcast.
"""

from __future__ import annotations

import re
import string
from array import array
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Longer units are not shuffled.
LONGEST_UNIT = 64
#: Longest word whose ids are kept, and how many of those that are no unit themselves.
LONGEST_KEPT, MOST_KEPT = 1024, 100_000
CHUNK_DOCS = 16_384
#: Characters of texts that are cut at once, and texts that are read at once for their chunks.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 256
#: Rows that are encoded together, and bytes up to which small tables are put together for it.
ROWS_ENCODED, BYTES_ENCODED = 1024, 4 << 20
#: Partitions of distinct units for each chunk of documents.
UNIT_PARTS = 12
#: A piece of the model's n-th rank has the log-probability -ln(n + SHIFT), up to a constant.
SHIFT = 10
FALLBACK = -30.0
INNER = "\x00"  # starts the name of a unit that does not follow a blank
# Packed lattice: an edge is end, start, id + 1 and cost; a best path's end is cost, start, id + 1.
COST_BITS, ID_BITS, PLACE_BITS = 20, 16, 7
COST_UNIT = 10_000
RUNS = re.compile(" +[^ \x00" + BLANK + "]*|[\x00" + BLANK + "]|[^ \x00" + BLANK + "]+")


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return n, at


def messages(data: bytes):
    """(field, value) of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif key & 7 == 0:
            value, at = varint(data, at)
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Model:
    """Pieces of a model file: ordinary pieces with scores, byte pieces, and each id's bytes."""

    NORMAL, BYTE = 1, 6

    def __init__(self, file: bytes):
        self.pieces: list[tuple[str, int, float]] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for number, value in messages(file):
            if number != 1:
                continue
            fields = dict(messages(value))
            text, kind, n = fields[1].decode(), fields.get(3, self.NORMAL), len(self.bytes_of)
            raw = b""
            if kind == self.NORMAL:
                self.pieces.append((text, n, -float(np.log(len(self.pieces) + SHIFT))))
                raw = text.replace(BLANK, " ").encode()
            elif kind == self.BYTE:
                self.byte_ids[int(text[3:5], 16)] = n
                raw = bytes([int(text[3:5], 16)])
            self.bytes_of.append(raw)
        self.longest = max(len(p) for p, _, _ in self.pieces)

    @classmethod
    def read(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def cutter(self) -> Cutter:
        return Cutter([p for p, _, _ in self.pieces])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = pd.DataFrame(self.pieces, columns=["piece", "id", "score"])
        return spark.createDataFrame(rows, "piece string, id int, score double")


class Cutter:
    """Cuts texts between characters that are side by side in no piece.

    A unit has a name: what follows its first blank, or ``INNER`` and the unit. Blanks are
    written with the blank mark. A mark that stands for itself is a unit of its own.
    """

    def __init__(self, pieces: list[str]):
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(p[1] == BLANK != p[0] or INNER in p for p in self.joined):
            raise ValueError("a piece reaches across the start of a word or a NUL")
        self.ends_lines = not any("\n" in p for p in self.joined)

    def words(self, text: str) -> list[str]:
        """The text in parts, each named like a unit, that ``cut`` cuts further."""
        if self.ends_lines and not (text.startswith(" ") or "  " in text or INNER in text or BLANK in text):
            return text.replace("\n", f" {INNER}\n {INNER}").split(" ")
        out = []
        for run in RUNS.findall(" " + text):
            word = run.lstrip(" ")
            blanks = len(run) - len(word)
            out.append(BLANK * (blanks - 1) + word if blanks else INNER + word)
        return out

    def halves(self, word: str) -> tuple[str, ...]:
        """A part without the punctuation at its end, and that punctuation, if a unit ends between them."""
        core = word.rstrip(string.punctuation)
        if core == word or core in ("", INNER) or core[-1] + word[len(core)] in self.joined:
            return (word,)
        return core, INNER + word[len(core) :]

    def cut(self, word: str) -> list[str]:
        """Names of the units of a part."""
        if word == INNER + BLANK:
            return [word]
        unit, joined = word[1:] if word.startswith(INNER) else BLANK + word, self.joined
        ends = [i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in joined] + [len(unit)]
        found = [unit[i:j] for i, j in zip([0, *ends], ends)] if unit else []
        return [u[1:] if u[0] == BLANK else INNER + u for u in found]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the characters as texts write them, 0 for those in no pair, and which numbers are joined side by side."""
        chars = sorted({c for p in self.joined for c in p})
        number = np.zeros(0x110000, np.uint16)
        number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in self.joined:
            joined[number[ord(a)], number[ord(b)]] = True
        # A blank of a text is the blank mark of pieces, and a mark in a text is in no pair.
        number[ord(" ")], number[ord(BLANK)] = number[ord(BLANK)], 0
        return number, joined

    def spelled_units(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The units of some texts: distinct ones as texts spell them, the places of all among these, and where each text's units end.

        The same units as those of ``words`` and ``cut``, for all characters at once.
        """
        text = "".join([" " + t for t in texts])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        number, joined = self.pairs
        kinds = number[codes]
        last = np.append(~joined[kinds[:-1], kinds[1:]], True)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        last[text_ends - 1] = True
        ends = np.flatnonzero(last) + 1
        data = text.encode()
        if len(data) == len(text):
            at = ends
        else:
            at = np.cumsum(1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)[ends - 1]
        offsets = np.concatenate([[0], at]).astype(np.int64)
        units = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        return units.dictionary.cast(pa.string()), units.indices.to_numpy(), np.searchsorted(ends, text_ends, "right")


def unit_name(spelled: str) -> str:
    """The name of a unit as texts spell it."""
    return spelled[1:].replace(" ", BLANK) if spelled[0] == " " else INNER + spelled


def unit_spelled(name: str) -> str:
    """The unit of a name as texts spell it."""
    return name[1:] if name.startswith(INNER) else " " + name.replace(BLANK, " ")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """The strings of a column, without a scalar for each."""
    return column.to_numpy(zero_copy_only=False).tolist() if isinstance(column, pa.Array) else column.to_numpy().tolist()


def portions(texts: list[str]):
    """Texts side by side, ``CHARS_AT_ONCE`` characters at a time or one text."""
    some, size = [], 0
    for text in texts:
        if some and size + len(text) > CHARS_AT_ONCE:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


def taken(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``start`` and are ``n`` long, one after another."""
    ends = np.cumsum(n)
    at = np.repeat((start - ends + n).astype(np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64), n)
    at += np.arange(len(at), dtype=at.dtype)
    return values[at]


@cache
def default_cutter() -> Cutter:
    return Model.read().cutter()


def names(text: str, cutter: Cutter | None = None) -> list[str]:
    """Names of the units of a text, in order."""
    cutter = cutter or default_cutter()
    return [name for word in cutter.words(text) for name in cutter.cut(word)]


class Folder:
    """The best path through one unit of any length; ties as in ``encoded_units``."""

    def __init__(self, model: Model):
        self.edges = {p: (round(-s * COST_UNIT), i) for p, i, s in model.pieces}
        self.byte_ids = model.byte_ids
        self.lengths: dict[str, set[int]] = {}  # of pieces, by their last two characters
        for p in self.edges:
            if len(p) > 1:
                self.lengths.setdefault(p[-2:], set()).add(len(p))

    def ids(self, name: str) -> bytes:
        unit = name[1:] if name.startswith(INNER) else BLANK + name
        spelled = (round(-FALLBACK * COST_UNIT), -1)
        total, starts, chosen = array("q", [0]), array("q", [0]), array("i", [0])
        for e in range(1, len(unit) + 1):
            cost, n = self.edges.get(unit[e - 1], spelled)
            best = (total[e - 1] + cost, e - 1, n)
            for k in self.lengths.get(unit[max(e - 2, 0) : e], ()):
                if k <= e and (edge := self.edges.get(unit[e - k : e])):
                    best = min(best, (total[e - k] + edge[0], e - k, edge[1]))
            total.append(best[0]), starts.append(best[1]), chosen.append(best[2])
        out, e = array("i"), len(unit)
        while e:
            if chosen[e] < 0:
                out.extend(self.byte_ids[b] for b in reversed(unit[e - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(chosen[e])
            e = starts[e]
        return np.array(out[::-1], np.int32).tobytes()


class Encodings(dict):
    """Ids of the parts of texts: those of units, and others put together from them when first asked for.

    A part that bears the name of a unit is that unit. The plain way, one part after another, to which tests compare ``UnitTable``.
    """

    def __init__(self, cutter: Cutter, folder: Folder, known: dict[str, bytes]):
        super().__init__(known)
        self.cutter, self.folder, self.more = cutter, folder, []

    def __missing__(self, word: str) -> bytes:
        halves = self.cutter.halves(word)
        if len(halves) == 2:
            ids = self[halves[0]] + self[halves[1]]
        else:
            units = self.cutter.cut(word)
            # A unit that is not known is a long one.
            ids = b"".join([self[n] if len(n) <= LONGEST_UNIT else self.folder.ids(n) for n in units])
        if len(word) <= LONGEST_KEPT:
            if len(self.more) >= MOST_KEPT:
                for old in self.more:
                    del self[old]
                self.more = []
            self[word] = ids
            self.more.append(word)
        return ids


class UnitTable:
    """Ids of the units of a chunk in one array; texts are encoded by gathering from it."""

    def __init__(self, cutter: Cutter, folder: Folder, units: pa.StringArray, n_ids: np.ndarray, ids: np.ndarray):
        """``units`` as texts spell them, how many ids each has, and the ids of all."""
        self.cutter, self.folder, self.units, self.ids, self.n = cutter, folder, units, ids, n_ids.astype(np.int64)
        self.start = np.cumsum(self.n) - self.n

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not texts:
            return []
        cut = [self.cutter.spelled_units(some) for some in portions(texts)]
        # Looked up together, as a lookup goes over the whole table.
        units = pa.concat_arrays([c[0] for c in cut])
        place = pc.index_in(units, self.units).fill_null(-1).to_numpy()
        known = place >= 0
        n = np.zeros(len(place), np.int64)
        n[known] = self.n[place[known]]
        ids = [taken(self.ids, self.start[place[known]], n[known])]
        start = np.cumsum(n) - n
        # A unit that is not known is a long one.
        size = len(ids[0])
        for i in np.flatnonzero(~known).tolist():
            ids.append(np.frombuffer(self.folder.ids(unit_name(units[i].as_py())), np.int32))
            start[i], n[i] = size, len(ids[-1])
            size += len(ids[-1])
        ids, first, out = np.concatenate(ids), 0, []
        for own, index, ends in cut:
            index = index + first
            first += len(own)
            each = n[index]
            data = taken(ids, start[index], each).tobytes()
            bounds = (4 * np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends])]).tolist()
            out += [data[i:j] for i, j in zip(bounds, bounds[1:])]
        return out


def parts(table: pa.Table, chunk: np.ndarray) -> pa.RecordBatch:
    """The rows of a table packed by chunk, as compressed Arrow streams."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    order = np.argsort(chunk, kind="stable")
    keys, starts = np.unique(chunk[order], return_index=True)
    packed = []
    for a, b in zip(starts, [*starts[1:], len(chunk)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as out:
            # Only the rows at hand are copied.
            out.write_table(table.take(order[a:b]).combine_chunks())
        packed.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], ["chunk", "packed"])


def packer(n_chunks: int):
    """Packs rows (row columns, text) by chunk."""

    def pack(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            table = pa.Table.from_batches([batch])
            chunk = [digest(f"{i}\n{t}".encode("utf-8", "surrogatepass")) % n_chunks
                     for some in table.select(["doc_id", "text"]).to_batches(max_chunksize=TEXTS_AT_ONCE)
                     for i, t in zip(some["doc_id"].to_pylist(), some["text"].to_pylist())]
            yield parts(table, np.array(chunk, np.int32))

    return pack


def unit_packer(batches):
    """Packs encodings (chunk, name, ids) by chunk."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        yield parts(table.select(["name", "ids"]), table["chunk"].to_numpy().astype(np.int32))


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def unpacked_some(packed: pa.ChunkedArray):
    """The rows of packed tables, ``ROWS_ENCODED`` at most at a time; small tables are put together."""
    some, size = [], 0
    for data in packed:
        some.append(unpacked(data.as_buffer()))
        size += some[-1].nbytes
        if size >= BYTES_ENCODED:
            yield from cut_rows(some)
            some, size = [], 0
    if some:
        yield from cut_rows(some)


def cut_rows(tables: list[pa.Table]):
    table = pa.concat_tables(tables)
    for at in range(0, len(table), ROWS_ENCODED):
        yield table.slice(at, ROWS_ENCODED)


def lister(cutter: Cutter):
    """Distinct units of every chunk. The parts of a chunk follow one another, so each unit comes once."""

    def distinct(found: list[pa.StringArray]) -> list[pa.StringArray]:
        return [pa.concat_arrays(found).unique()] if found else []

    def listed(found: list[pa.StringArray], chunk: int):
        for units in distinct(found):
            for at in range(0, len(units), 50_000):
                part = [n for n in map(unit_name, strings(units[at : at + 50_000])) if len(n) <= LONGEST_UNIT]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(len(part), chunk, np.int32))], ["name", "chunk"])

    def run(batches):
        # Only the chunk at hand is held.
        now, found, most, waiting = None, [], 0, []

        def add(least: int):
            nonlocal found, most
            if sum(t.nbytes for t in waiting) < least:
                return
            for some in portions([t for table in waiting for t in strings(table["text"]) if t is not None]):
                found.append(cutter.spelled_units(some)[0])
                if sum(map(len, found)) > most:
                    found = distinct(found)
                    most = 2 * len(found[0]) + 100_000
            waiting.clear()

        for batch in batches:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["packed"]):
                if chunk != now:
                    add(0)
                    yield from listed(found, now)
                    now, found, most = chunk, [], 0
                waiting.append(unpacked(data.as_buffer()).select(["text"]))
                add(CHARS_AT_ONCE)
        add(0)
        yield from listed(found, now)

    return run


def unit_text(name):
    """What the lattice of a unit spells."""
    return F.when(name.startswith(INNER), F.substring(name, 2, LONGEST_UNIT)).otherwise(F.concat(F.lit(BLANK), name))


def encoded_units(units: DataFrame, pieces: DataFrame, longest: int, byte_ids: list[int]) -> DataFrame:
    """Adds ``ids`` to units (name, chunks): the best path through each unit's lattice.

    The best path has the largest sum of scores, kept as whole ten-thousandths; of equal
    sums, the longer last piece, then the smaller id. A mark that stands for itself is no blank and is spelled in bytes.
    """
    spelled = units.withColumn("unit", unit_text(F.col("name"))).withColumn("n", F.length("unit"))
    starts = spelled.select("name", "unit", "n", "chunks", F.explode(F.expr("sequence(0, n - 1)")).alias("start"))
    spans = starts.select(
        "name", "unit", "start", F.when(F.col("start") == 0, F.col("chunks")).alias("chunks"),
        F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("start")))).alias("len"),
    )
    edges = (
        spans.select("name", "start", "len", F.when(F.col("len") == 1, F.col("chunks")).alias("chunks"),
                     F.expr("substring(unit, start + 1, len)").alias("sub"))
        .join(F.broadcast(pieces), (F.col("sub") == F.col("piece")) & (F.col("name") != INNER + BLANK), "left")
        .where("id is not null or len = 1")
    )
    packed = (
        F.shiftleft((F.col("start") + F.col("len")).cast("long"), PLACE_BITS + ID_BITS + COST_BITS)
        + F.shiftleft(F.col("start").cast("long"), ID_BITS + COST_BITS)
        + F.shiftleft((F.coalesce("id", F.lit(-1)) + 1).cast("long"), COST_BITS)
        + F.round(-F.coalesce("score", F.lit(FALLBACK)) * COST_UNIT).cast("long")
    )
    lattice = edges.groupBy("name").agg(
        F.first("chunks", ignorenulls=True).alias("chunks"), F.sort_array(F.collect_list(packed)).alias("edges")
    ).withColumn("unit", unit_text(F.col("name"))).withColumn("n", F.length("unit"))
    step = (
        f"shiftleft(shiftright({{best}}, {PLACE_BITS + ID_BITS}) + (x & {(1 << COST_BITS) - 1}), {PLACE_BITS + ID_BITS})"
        f" + (shiftright(x, {COST_BITS}) & {(1 << PLACE_BITS + ID_BITS) - 1})"
    )
    top, mask, id_mask = PLACE_BITS + ID_BITS, (1 << PLACE_BITS) - 1, (1 << ID_BITS) - 1
    # Edges come by end. ``done`` holds the best paths to all ends before the one at hand.
    best = F.expr(
        f"""aggregate(edges, named_struct('done', cast(array() as array<long>), 'now', 0L),
              (acc, x) -> if(shiftright(x, {top + COST_BITS}) = size(acc.done),
                named_struct('done', acc.done, 'now', least(acc.now, {step.format(best="acc.done[start]")})),
                named_struct('done', concat(acc.done, array(acc.now)), 'now', {step.format(best="if(start = size(acc.done), acc.now, acc.done[start])")})),
              acc -> concat(acc.done, array(acc.now)))""".replace("start", f"cast(shiftright(x, {ID_BITS + COST_BITS}) & {mask} as int)")
    )
    back = F.expr(
        f"""aggregate(sequence(n, 1, -1), named_struct('at', n, 'path', cast(array() as array<long>)),
              (acc, e) -> if(acc.at = e,
                named_struct('at', cast(shiftright(best[e], {ID_BITS}) & {mask} as int),
                             'path', concat(array(best[e] & {(1 << top) - 1}), acc.path)),
                acc),
              acc -> acc.path)"""
    )
    table = F.array(*map(F.lit, byte_ids))
    char = f"substring(unit, cast(shiftright(p, {ID_BITS}) as int) + 1, 1)"
    spelled_out = F.expr(
        f"""if(exists(path, p -> p & {id_mask} = 0),
              flatten(transform(path, p -> if(p & {id_mask} > 0, array(cast(p & {id_mask} as int) - 1),
                transform(sequence(1, octet_length({char})),
                  k -> byte_ids[cast(conv(hex(substring(encode({char}, 'utf-8'), k, 1)), 16, 10) as int)])))),
              transform(path, p -> cast(p & {id_mask} as int) - 1))"""
    )
    return (
        lattice.withColumn("best", best)
        .withColumn("path", back)
        .withColumn("byte_ids", table)
        .select("name", "chunks", spelled_out.alias("ids"))
    )


class Speller:
    """Texts of piece ids: bytes of all pieces in one array, taken by place and length."""

    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, all in one gather."""
        return taken(self.flat, self.start[ids], self.length[ids]).tobytes()

    def text(self, ids: np.ndarray) -> str:
        """The bytes of the ids, without the blank in front."""
        return self.spelled(ids)[1:].decode("utf-8", "replace")

    def exact(self, texts: list[str | None], found: list[bytes | None]) -> list[bool | None]:
        """Whether the ids of each text spell it: for many at once, and one by one only if some do not."""
        own = [i for i, t in enumerate(texts) if t is not None]
        out: list[bool | None] = [None] * len(texts)
        for k in range(0, len(own), 256):
            some = own[k : k + 256]
            want = "".join([f" {texts[i]}" for i in some]).encode("utf-8", "replace")
            ids = np.frombuffer(b"".join([found[i] for i in some]), np.int32)
            # Equal as a whole, and each part must have its text's length.
            if same := self.spelled(ids) == want:
                size = np.concatenate([[0], np.cumsum(self.length[ids])])
                ends = np.cumsum([0] + [len(found[i]) // 4 for i in some])
                same = np.diff(size[ends]).tolist() == [len(texts[i].encode("utf-8", "replace")) + 1 for i in some]
            for i in some:
                out[i] = same or self.text(np.frombuffer(found[i], np.int32)) == texts[i]
        return out


def applier(model: Model, columns: list[str]):
    """Encodes the texts of a chunk with the encodings of its units, and decodes them again."""
    pieces, cutter, folder = model.bytes_of, model.cutter(), Folder(model)

    def apply(packed: pa.Table, units: pa.Table) -> pa.Table:
        speller = Speller(pieces)
        spelled, n_ids, flat = [pa.array([], pa.string())], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for batch in (b for data in units["packed"].to_pylist() for b in unpacked(data).to_batches()):
            spelled.append(pa.array(list(map(unit_spelled, strings(batch["name"]))), pa.string()))
            n_ids.append(np.diff(batch["ids"].offsets.to_numpy()))
            flat.append(batch["ids"].flatten().to_numpy(zero_copy_only=False).astype(np.int32))
        encodings = UnitTable(cutter, folder, pa.concat_arrays(spelled), np.concatenate(n_ids), np.concatenate(flat))
        out = []
        for table in unpacked_some(packed["packed"]):
            texts = strings(table["text"])
            ids_of = iter(encodings.encoded([t for t in texts if t is not None]))
            found = [None if t is None else next(ids_of) for t in texts]
            exact = speller.exact(texts, found)
            lengths = np.array([len(x or b"") // 4 for x in found])
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32(), mask=np.array([x is None for x in found] + [False]))
            values = pa.array(np.frombuffer(b"".join(x or b"" for x in found), np.int32))
            out.append(
                table.select(columns)
                .append_column("ids", pa.ListArray.from_arrays(ends, values))
                .append_column("exact", pa.array(exact, pa.bool_()))
            )
        if out:
            return pa.concat_tables(out)
        return pa.table({c: pa.array([]) for c in [*columns, "ids", "exact"]})

    return apply


def encode(docs: DataFrame, model: Model, chunk_docs: int = CHUNK_DOCS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes the texts of ``docs`` (doc_id, text): doc_id, ``keep``, ids, n_pieces, exact.

    ``exact`` says that decoding ``ids`` gives the text back. An empty text is one blank
    piece; a null text has null ids, 0 pieces and a null ``exact``. The ids are the best path of
    the whole text, with a blank in front. Null ids, repeated rows and columns of other names do not matter;
    an empty table gives no rows. A chunk is the rows of one hash value of id and text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", *keep, "text")
    n_chunks = max(1, -(-docs.count() // chunk_docs))
    packed = rows.mapInArrow(packer(n_chunks), "chunk int, packed binary").repartition("chunk")
    # Each chunk lists a unit once, so nothing is gained by summing up before this shuffle.
    units = packed.sortWithinPartitions("chunk").mapInArrow(lister(model.cutter()), "name string, chunk int").repartition(max(UNIT_PARTS * n_chunks, 8), "name")
    units = units.groupBy("name").agg(F.collect_set("chunk").alias("chunks"))
    ids = encoded_units(units, model.table(spark), model.longest, model.byte_ids)
    by_chunk = ids.select(F.explode("chunks").alias("chunk"), "name", "ids").mapInArrow(unit_packer, "chunk int, packed binary")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    out = (
        packed.groupBy("chunk").cogroup(by_chunk.groupBy("chunk"))
        .applyInArrow(applier(model, ["doc_id", *keep]), f"{kept}ids array<int>, exact boolean")
    )
    return out.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))


def decode(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` (null stays null), in place of any text there is."""
    rows = rows.drop("text")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    pieces = model.bytes_of

    def run(batches):
        speller = Speller(pieces)
        for batch in batches:
            yield batch.assign(text=[None if x is None else speller.text(np.asarray(x, np.int64)) for x in batch["ids"].tolist()])

    return rows.mapInPandas(run, f"{kept}text string")
