import zlib

import numpy as np
import pytest
from tests.llm.helpers import frame, odd_rows, prose, row
from tokenizers import Tokenizer

from flowtrail.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def checked(tokenizer, rows, pieces):
    """Every id once, sequences gapless and within capacity; returns the share of padding."""
    want = sorted((str(r[0]), tuple(expected(tokenizer, r[1]))) for r in rows)
    of_doc = {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        of_doc.setdefault(str(p.doc_id), []).append(p)
    got = []
    for name, own in of_doc.items():
        # Rows with one id: their pieces are told apart by going through them in the order of places.
        own.sort(key=lambda p: p.start)
        open_ends = []
        for p in own:
            ids = tuple(np.frombuffer(p.ids, "<u4").tolist())
            if p.start == 0:
                open_ends.append((ids, p.doc_tokens))
                continue
            at = next(i for i, (x, n) in enumerate(open_ends) if len(x) == p.start and n == p.doc_tokens
                      and any(w[: len(x) + len(ids)] == x + ids for m, w in want if m == name))
            open_ends[at] = (open_ends[at][0] + ids, p.doc_tokens)
        assert all(len(x) == n for x, n in open_ends)
        got += [(name, x) for x, _ in open_ends]
    assert sorted(got) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    tokens = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        tokens += at
        padded += at if at & (at - 1) == 0 else packing.CAPACITY
    return 1 - tokens / padded if padded else 0


def test_every_id_lies_in_one_piece_of_a_gapless_sequence(spark, tokenizer):
    rows = [row(i, prose(5 + 37 * i % 900, i)) for i in range(300)] + odd_rows()
    rows += [row(500, "Don't <|endoftext|> İSTANBUL x\x1cy\x85z é é 日本語 " + "q" * 5000), row(501, "ſ's I'LL 😀👍🏽 Σας ŉ")]
    out = packing.pack(frame(spark, rows))
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]
    assert checked(tokenizer, rows, out.collect()) < 0.03


def test_many_repeated_rows_and_small_groups(spark, tokenizer):
    rows = [row(7, "the same few words in all rows")] * 400 + [row(None, "no id")] * 50
    assert checked(tokenizer, rows, packing.pack(frame(spark, rows), group_windows=1).collect()) < 0.4


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0


def test_query_gives_checksums_and_no_ids(spark, tokenizer, tmp_path):
    rows = [row(i, prose(300, i)) for i in range(9)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_packing(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset"]
    texts = {r[0]: expected(tokenizer, r[1]) for r in rows}
    for p in out.collect():
        assert p.ids_crc32 == zlib.crc32(np.array(texts[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())


def test_sequences_hold_their_pieces_in_order(spark):
    pieces = packing.pack(frame(spark, [row(i, prose(700, i)) for i in range(20)]))
    of = {}
    for p in pieces.collect():
        of.setdefault(p.sequence_id, []).append((p.offset, bytes(p.ids)))
    for s in packing.sequences(pieces).collect():
        assert bytes(s.ids) == b"".join(x for _, x in sorted(of[s.sequence_id])) and s.tokens == len(s.ids) // 4


def test_differencing_by_hand_and_against_plain_version():
    # 8 and 7 go apart, then 6, 5 and 4 meet the emptier side: the textbook case with a difference of 2.
    assert sorted(np.bincount(packing.differenced(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]

    def plain(sizes, k):
        parts = [(sorted([(0, ())] * (k - 1) + [(s, (i,))]), i) for i, s in enumerate(sizes)]
        made = len(sizes)
        while len(parts) > 1:
            parts.sort(key=lambda p: (-(p[0][-1][0] - p[0][0][0]), p[1]))
            (a, _), (b, _), *parts = parts
            parts.append((sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, b[::-1])), key=lambda w: w[0]), made))
            made += 1
        return [sum(sizes[i] for i in members) for _, members in parts[0][0]]

    rng = np.random.default_rng(4)
    for _ in range(30):
        k, sizes = int(rng.integers(2, 9)), rng.integers(1, 500, rng.integers(1, 60))
        found = packing.differenced(sizes, k)
        assert sorted(np.bincount(found, sizes, k).astype(int)) == sorted(plain(sizes.tolist(), k))


def test_short_parts_share_items():
    sizes = np.array([100, 31, 31, 31, 5, 1, 32, 1])
    item = packing.bundled(sizes)
    assert len(set(item[[0, 6]])) == 2 and len(set(item)) < 6 and not set(item[[0, 6]]) & set(item[[1, 2, 3, 4, 5, 7]])
    many = np.ones(100_000, int)
    assert np.bincount(packing.bundled(many)).max() == 64


def test_window_count_rises_until_all_fits():
    sizes = np.array([1500] * 5)
    assert packing.windows(sizes, 2048).max() == 4  # two never fit together; 4 windows would do by sum
    sizes = np.random.default_rng(2).integers(1, 513, 2000)
    found = packing.windows(sizes, 2048)
    assert np.bincount(found, sizes).max() <= 2048 and found.max() + 1 <= 1.02 * sizes.sum() / 2048 + 1


def test_words_with_any_stops_are_put_together_and_the_tokenizer_is_made_once(tokenizer):
    asked = []

    class Counted(packing.Ids):
        def encoded(self, text):
            asked.append(text)
            return super().encoded(text)

    known = Counted(tokenizer)
    texts = ["Wort$$$ wort&&& Été*** x, (a) it's I'LL ll' a'' don't!!! \"quoted\" a-b x's'; é$ K Å ß## <|y ſ€", "word%%%", "'s ''s '$ $'s"]
    for text in texts:
        assert np.frombuffer(known.text(text), "<u4").tolist() == expected(tokenizer, text)[:-1]
    assert "$$$" in asked and not {"Wort$$$", "wort&&&", "Été***", "word%%%"} & set(asked)
    assert packing.read(packing.read_tokenizer()) is packing.read(packing.read_tokenizer())
