import random
import tracemalloc

import numpy as np
import pyarrow as pa
from tests.llm.helpers import frame, odd_rows, prose, row

from flowtrail.llm import pieces

MODEL = pieces.Model.read()
SCORES = {p: (i, round(-s * pieces.COST_UNIT)) for p, i, s in MODEL.pieces}


def best_path(unit, literal=False):
    """Plain Viterbi over a unit; ties as in the operator."""
    ends = [(0, 0, 0, [])]
    for e in range(1, len(unit) + 1):
        found = []
        for s in range(max(0, e - MODEL.longest), e):
            piece, cost = unit[s:e], None
            if piece in SCORES and not literal:
                n, cost = SCORES[piece]
                ids = [n]
            elif e - s == 1:
                n, cost = -1, round(-pieces.FALLBACK * pieces.COST_UNIT)
                ids = [MODEL.byte_ids[b] for b in piece.encode()]
            if cost is not None:
                found.append((ends[s][0] + cost, s, n, ends[s][3] + ids))
        ends.append(min(found))
    return ends[-1][3]


def brute(text):
    out = []
    for name in pieces.names(text):
        if name == pieces.INNER:
            continue
        inner = name.startswith(pieces.INNER)
        out += best_path(name[1:] if inner else pieces.BLANK + name, name == pieces.INNER + pieces.BLANK)
    return out


def test_ids_are_the_best_paths_and_decode_exactly(spark):
    rows = [row(1, prose(200)), row(2, "Hello, World.\nNew line.  Two blanks, a ▁ mark\tand a tab.\r\n"),
            row(3, "supercalifragilistic" * 8), row(4, " . , \n\n x"), row(5, "日本語 and ελληνικά and 😀.")] + odd_rows()
    out = pieces.encode(frame(spark, rows), MODEL, chunk_docs=4, keep=("lang",))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for doc_id, text, *_ in rows:
        for r in got[doc_id]:
            if text is None:
                assert r.ids is None and r.n_pieces == 0 and r.exact is None
            else:
                assert r.exact and r.ids == brute(text) and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in pieces.decode(out, MODEL).collect()}
    assert all(back[i] == t for i, t, *_ in rows)


def test_empty_table(spark):
    assert pieces.encode(frame(spark, []), MODEL).count() == 0


def whole_path(text):
    """Plain Viterbi over the whole text, without any units."""
    marked = (" " + text).replace(pieces.BLANK, "\ue000").replace(" ", pieces.BLANK)
    best = [(0, 0, 0)]
    for e in range(1, len(marked) + 1):
        found = [(best[s][0] + SCORES[marked[s:e]][1], s, SCORES[marked[s:e]][0])
                 for s in range(max(0, e - MODEL.longest), e) if marked[s:e] in SCORES]
        if marked[e - 1] not in SCORES:
            found.append((best[e - 1][0] + round(-pieces.FALLBACK * pieces.COST_UNIT), e - 1, -1))
        best.append(min(found))
    ids, e = [], len(marked)
    while e:
        _, s, n = best[e]
        raw = marked[s:e].replace("\ue000", pieces.BLANK).encode()
        ids = ([MODEL.byte_ids[b] for b in raw] if n < 0 else [n]) + ids
        e = s
    return ids


def test_ids_are_the_best_path_of_the_whole_text(spark):
    code = "def f(x):\n    if (x), y:\n        return \"a\", 'b'...\r\n\t\tend);\r\n"
    base = 'He said "x), y", (see z). Then... \'no\', [1], 2.5% of _it_.'
    texts = [code, base, "  two first", "end  ", " ", "   ", "\n", " \n  x", "a" + " " * 150 + "b" + " " * 37, "=" * 500 + " x " + "-" * 77,
             "https://example.com/" + "path/to?x=1&y=abcdefghij" * 20, "word" * 40 + ". " + "supercalifragilistic" * 30,
             "▁ ▁▁ a▁b ▁", "\x00 \x00a b\x00", "数据处理。日本語のテキスト、" * 30, "QmFzZTY0IGp1bms" * 40, prose(300) + ", " + code, "é😀ü " * 30]
    rng = random.Random(3)
    texts += ["".join(rng.choice('ab,.)( "\'\n\r\t▁\x00  the') for _ in range(200)) for _ in range(30)]
    texts += ["".join(rng.choice(MODEL.pieces)[0].replace(pieces.BLANK, " ") for _ in range(60)) for _ in range(30)]
    got = {r.doc_id: r for r in pieces.encode(frame(spark, [row(i, t) for i, t in enumerate(texts)]), MODEL, chunk_docs=30).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == whole_path(text), text
        assert got[i].exact
    # Indentation and closing marks get pieces of their own.
    spelled = [p for p, _, _ in MODEL.pieces]
    by_id = {n: p for p, n, _ in MODEL.pieces}
    assert ")," in spelled and ")," in [by_id.get(n) for n in got[1].ids] and max(len(by_id.get(n, "")) for n in got[8].ids) == 16


def test_what_follows_leaves_the_ids_before_it(spark):
    base = 'He said "x), y", (see z).  Then, x'
    rows = [row(i, base + more) for i, more in enumerate(["", "\t", " " + "w" * 100, " \x00", " ▁", "\x0b\n", " https://a.b/" + "c1" * 80])]
    ids = {r.doc_id: r.ids for r in pieces.encode(frame(spark, rows), MODEL).collect()}
    assert all(ids[i][: len(ids[0])] == ids[0] for i in ids)


def test_many_texts_at_once_are_told_exact_one_by_one():
    model = pieces.Model.read()
    speller, folder, cutter = pieces.Speller(model.bytes_of), pieces.Folder(model), model.cutter()
    texts = ["a few words", "", None, "é 日本 x", "more words here"] * 120
    found = [None if t is None else b"".join(folder.ids(n) for n in pieces.names(t, cutter)) for t in texts]
    assert speller.exact(texts, found) == [None if t is None else True for t in texts]
    # Ids that belong to the neighbour, and ids of another text.
    moved = list(found)
    moved[0], moved[1] = found[0] + found[1], b""
    assert speller.exact(texts, moved)[:3] == [False, True, None]  # no ids spell the empty text
    moved = [found[4], *found[1:]]
    assert speller.exact(texts, moved) == [False, *[None if t is None else True for t in texts[1:]]]


def test_words_before_punctuation_are_cut_once_and_units_take_no_place_of_words(monkeypatch):
    cutter, folder = MODEL.cutter(), pieces.Folder(MODEL)
    rng = random.Random(5)
    texts = ["word word, word. (word) word... x), y\n▁, ▁. ,, . end$$$ end&&&. \x00, " + "q" * 90 + ", a" + "!" * 80]
    texts += ["".join(rng.choice("ab,.)($ \n\t▁\x00é") for _ in range(80)) for _ in range(200)]
    units = {n for t in texts for n in pieces.names(t, cutter)}
    known = {n: folder.ids(n) for n in units if len(n) <= pieces.LONGEST_UNIT}
    for most in (2, 1000):
        monkeypatch.setattr(pieces, "MOST_KEPT", most)
        found = pieces.Encodings(cutter, folder, known)
        for t in texts:
            assert b"".join(found[w] for w in cutter.words(t)) == b"".join(map(folder.ids, pieces.names(t, cutter)))
        assert len(found.more) <= most and known.items() <= found.items() and len(found) == len(known) + len(found.more)
    asked = []
    monkeypatch.setattr(cutter, "cut", lambda w, cut=cutter.cut: asked.append(w) or cut(w))
    found = pieces.Encodings(cutter, folder, {"word": folder.ids("word"), **{pieces.INNER + c: folder.ids(pieces.INNER + c) for c in ",.;"}})
    assert all(found[w] for w in ("word", "word,", "word.", "word;")) and not asked


def test_units_of_a_chunk_are_listed_before_the_next_chunk_is_read():
    def texts(*rows):
        return pieces.parts(pa.table({"text": pa.array(rows)}), np.zeros(len(rows), np.int32))["packed"][0]

    def batch(chunk, *rows):
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([texts(*rows).as_py()], pa.binary())], ["chunk", "packed"])

    given, read = [batch(0, "a b, c", None), batch(0, "b d"), batch(1, "b e"), batch(2, None), batch(3, "f")], []
    found = []
    for out in pieces.lister(MODEL.cutter())(read.append(b) or b for b in given):
        found.append((out["chunk"].to_pylist()[0], sorted(out["name"].to_pylist()), len(read)))
    units = lambda *rows: sorted({n for t in rows for n in pieces.names(t, MODEL.cutter())})
    assert found == [(0, units("a b, c", "b d"), 3), (1, units("b e"), 4), (3, units("f"), 5)]


def test_units_of_all_characters_at_once_equal_those_of_single_words(monkeypatch):
    cutter, folder = MODEL.cutter(), pieces.Folder(MODEL)
    rng = random.Random(7)
    texts = ["", " ", "\n", "▁", "\x00", " ▁▁  x, y.\n", "é日本, 😀x (ab)$$$", "q" * 90 + "  z", prose(80)]
    texts += ["".join(rng.choice('ab,.)( "\'\n\r\t▁\x00  theé日€😀9') for _ in range(rng.randrange(120))) for _ in range(200)]
    listed = [[n for n in pieces.names(t, cutter) if n != pieces.INNER] for t in texts]
    want = [b"".join(map(folder.ids, names)) for names in listed]
    known = sorted({n for names in listed for n in names if len(n) <= pieces.LONGEST_UNIT})
    ids = [np.frombuffer(folder.ids(n), np.int32) for n in known]
    packed = pieces.parts(pa.table({"text": texts}), np.zeros(len(texts), np.int32))
    # Neither side goes from word to word.
    for name in ("words", "cut", "halves"):
        monkeypatch.delattr(pieces.Cutter, name)
    for most in (50, 1 << 20):
        monkeypatch.setattr(pieces, "CHARS_AT_ONCE", most)
        assert sorted(n for b in pieces.lister(cutter)([packed]) for n in b["name"].to_pylist()) == known
        table = pieces.UnitTable(cutter, folder, pa.array(map(pieces.unit_spelled, known)), np.array([len(x) for x in ids]), np.concatenate(ids))
        assert table.encoded(texts) == want
    assert pieces.UnitTable(cutter, folder, pa.array([], pa.string()), np.zeros(0, int), np.zeros(0, np.int32)).encoded(["q" * 90]) == [folder.ids("q" * 90)]


def test_packing_holds_few_texts_beside_their_batch():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(4000)), "text": [f"{i} " * 500 for i in range(4000)]})
    tracemalloc.start()
    try:
        packed = next(iter(pieces.packer(3)([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    back = pa.concat_tables(pieces.unpacked(x.as_buffer()) for x in packed["packed"])
    assert back.sort_by("doc_id").equals(pa.table(batch)) and peak < batch.nbytes / 4
