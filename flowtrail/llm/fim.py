"""Fill-in-middle by displacement scatter.

The texts of an Arrow batch lie one after another in one byte array. Cuts come from one scan
of that array. Each text has three segments, and a segment moves as a whole: a difference
array holds, where a segment starts, by how much its shift differs from that of the segment
before. The cumulative sum gives every byte its place in the output, and one scatter writes
them all. Restoring finds the markers in the output, builds the same kind of array over the
restored bytes and gathers them back.

A batch is worked through in runs of rows of at most ``RUN_BYTES``; a longer text is a run of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEED, RATE, SUFFIX_FIRST = 42, 50, 80
RUN_BYTES = 2 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])
MARK = 3  # bytes of <P>, <S> and <M>
#: Order of the segments (0 prefix, 1 middle, 2 suffix) in the output of a form.
ORDER = {PSM: (0, 2, 1), SPM: (2, 0, 1)}
LETTER = np.frombuffer(b"PMS", np.uint8)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, nulls as empty, and where each text starts (one more place at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, at - at[0]


def texts(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    made = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat)])
    return made.cast(pa.string())


def runs(at: np.ndarray):
    """Ranges of rows of at most ``RUN_BYTES`` bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + RUN_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """Four 32-bit numbers for each id: the head of the SHA-256 of seed, colon and id (nothing for a null id)."""
    found = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(found, ">u4").reshape(-1, 4).astype(np.int64)


def marks(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of markers, the text each is in, and the segment it stands for."""
    place = np.flatnonzero(flat[:-2] == ord("<")) if len(flat) > 2 else np.empty(0, np.int64)
    place = place[(flat[place + 2] == ord(">")) & np.isin(flat[place + 1], LETTER)]
    text = np.searchsorted(at, place, "right") - 1
    inside = place + MARK <= at[text + 1]
    place, text = place[inside], text[inside]
    letter = flat[place + 1]
    return place, text, np.select([letter == x for x in LETTER], [0, 1, 2], -1)


def shifts(starts: np.ndarray, by: np.ndarray, size: int) -> np.ndarray:
    """The shift of every byte: segments begin at ``starts`` (ascending) and move ``by`` that much."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(by, prepend=0))
    return np.cumsum(steps[:size], out=steps[:size])


def scattered(flat: np.ndarray, at: np.ndarray, ids: list[int | None], seed: int, rate: int, suffix_first: int) -> dict:
    """Cuts, form and output of every text of a run."""
    begin, end = at[:-1], at[1:]
    size = end - begin
    space = SPACE[flat]
    first = np.zeros(len(flat), bool)
    first[1:] = space[1:] & ~space[:-1]
    first[begin[size > 0]] = True
    place = np.append(np.flatnonzero(first), len(flat))
    lead = np.searchsorted(place[:-1], at)
    n = np.diff(lead)
    draw = draws(ids, seed)
    one, two = draw[:, 0] % (n + 1), draw[:, 1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # Units are counted from a text's first one; after its last one comes its end.
    cut = [begin, np.minimum(place[lead[:-1] + low], end), np.minimum(place[lead[:-1] + high], end), end]
    form = np.where(draw[:, 3] % 100 < suffix_first, SPM, PSM)
    form[(size == 0) | (draw[:, 2] % 100 >= rate)] = PLAIN
    form[marks(flat, at)[1]] = PLAIN
    cut[1], cut[2] = np.where(form == PLAIN, end, cut[1]), np.where(form == PLAIN, end, cut[2])

    length = np.stack([cut[k + 1] - cut[k] for k in range(3)], axis=1)
    total = size + np.where(form == PLAIN, 0, 3 * MARK)
    out_at = np.concatenate([[0], np.cumsum(total)])
    to = np.repeat(out_at[:-1, None], 3, axis=1)  # where each segment starts in the output
    out = np.empty(out_at[-1], np.uint8)
    for kind, order in ORDER.items():
        rows = np.flatnonzero(form == kind)
        next_at = out_at[:-1][rows]
        for k in order:
            out[next_at], out[next_at + 1], out[next_at + 2] = ord("<"), LETTER[k], ord(">")
            to[rows, k] = next_at + MARK
            next_at = next_at + MARK + length[rows, k]
    starts = np.stack(cut[:3], axis=1)
    shift = shifts(starts.ravel(), (to - starts).ravel(), len(flat))
    shift += np.arange(len(flat))
    out[shift] = flat
    chars = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return {"n": n, "form": form, "prefix": chars[cut[1]] - chars[cut[0]], "middle": chars[cut[2]] - chars[cut[1]],
            "out": out, "out_at": out_at}


def gathered(flat: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that gave a run of outputs: markers say where the segments are."""
    place, text, segment = marks(flat, at)
    moved = form[text] != PLAIN
    place, text, segment = place[moved], text[moved], segment[moved]
    begin, end = at[:-1], at[1:]
    source = np.repeat(begin[:, None], 3, axis=1)
    length = np.zeros((len(begin), 3), np.int64)
    length[:, 0] = np.where(form == PLAIN, end - begin, 0)
    # A segment ends where the next marker of its text, or the text, does.
    last = np.append(text[1:] != text[:-1], True)[: len(text)]
    until = np.where(last, end[text], np.append(place[1:], 0)[: len(place)])
    source[text, segment] = place + MARK
    length[text, segment] = until - place - MARK
    ends = np.cumsum(length.ravel())
    starts = ends - length.ravel()
    size = int(ends[-1]) if len(ends) else 0
    shift = shifts(starts, source.ravel() - starts, size)
    shift += np.arange(size)
    return flat[shift], np.concatenate([[0], ends[2::3]])


def transform(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    A text has ``n`` units: a word with the white space before it, or white space at the end.
    Two draws from a hash of ``seed`` and id cut it into prefix, middle and suffix. ``rate``
    percent of texts are rearranged, ``suffix_first`` percent of these as spm; ``form`` is plain
    where the output is the text: always if it is null (counted as empty), empty or holds a
    marker itself. The lengths are in code points, null if plain. Null ids draw as an empty id.
    Repeated rows give equal rows; an empty table gives none. Other columns are left out.
    """
    rows = docs.select("doc_id", "text")

    def run(batches):
        for batch in batches:
            flat, at = laid_out(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j in runs(at):
                found = scattered(flat[at[i] : at[j]], at[i : j + 1] - at[i], ids[i:j].to_pylist(), seed, rate, suffix_first)
                plain = found["form"] == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(found["n"], pa.int64()), pa.array(FORMS[found["form"]], pa.string()),
                     pa.array(found["prefix"], pa.int64(), mask=plain), pa.array(found["middle"], pa.int64(), mask=plain),
                     texts(found["out"], found["out_at"])],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, name: str = "restored") -> DataFrame:
    """Adds the text that each ``output`` was made from, told from it and ``form`` alone.

    A null output gives an empty text, an unknown or null form counts as plain. A column called
    ``name`` is replaced, all others stay. Repeated rows give repeated rows, an empty table none.
    """
    rows = rows.drop(name)
    kept = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            flat, at = laid_out(batch.column("output"))
            form = np.array([{"psm": PSM, "spm": SPM}.get(x, PLAIN) for x in batch.column("form").to_pylist()], np.int64)
            for i, j in runs(at):
                made, made_at = gathered(flat[at[i] : at[j]], at[i : j + 1] - at[i], form[i:j])
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[i:j] for c in kept], texts(made, made_at)], [*kept, name])

    return rows.mapInArrow(run, f"{kinds}, {name} string")
