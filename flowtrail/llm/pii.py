"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The field labels the words of a text by their shapes and their neighbours' shapes. It is
trained from the small labelled table in ``pii_labels`` and finds what the patterns
refuse, such as a phone number run into a card number. Viterbi runs in numpy batches. A
word whose plain label leads by more than any change of its two transitions can make up for
keeps that label on every best path, so only the stretches between such words are decoded;
the result is the exact best path.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrail.llm.pii_labels import LABELLED

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")
TAGS = ("", *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails from its first digit fails from every later one.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"\S+")
MOST_CACHED, MOST_FORMS, LONGEST_CACHED = 300_000, 50_000, 256


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern: only text around an @ is looked at."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and start; matches that fail are dropped."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    for m in IP.finditer(text):
        # Compared without int(), which refuses thousands of digits.
        if all(len(x) < 3 or (len(x) == 3 and x <= "255") for x in (d.lstrip("0") for d in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def shape(word: str) -> str:
    """Letters as a or A (runs as one), digit runs with their length, other characters as they are; of the whole word."""
    word = word.rstrip(".,;:!?\"'")
    if word.isalpha():
        return "a" if word.islower() or len(word) == 1 else "A"
    word = re.sub(r"[^\W\d_]+", lambda m: "a" if m[0].islower() else "A", word)
    return re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>" if len(m[0]) < 20 else "<20>", word)


def features(form: str) -> list[str]:
    """What the field sees of a shape."""
    runs = [int(x) for x in re.findall(r"<(\d+)>", form)]
    n = sum(runs)
    marks = "".join(sorted(set(re.sub(r"<\d+>|[aA]", "", form))))
    return [
        "form=" + form,
        "marks=" + marks,
        f"digits={n if n < 5 else '5-7' if n < 8 else '8-15' if n < 16 else '16-19' if n < 20 else '20'}",
        f"runs={min(len(runs), 5)}",
        f"letters={'a' in form or 'A' in form}",
        f"first={form[:1]}",
        f"dots={min(form.count('.'), 4)},at={min(form.count('@'), 1)}",
    ]


def labelled(line: str) -> tuple[list[str], list[int]]:
    """Words and tags of a labelled line, where spans stand as {kind:text}."""
    words, tags = [], []
    for kind, span, plain in re.findall(r"\{(\w+):([^}]*)\}|([^{]+)", line):
        for w in (span or plain).split():
            if not kind and words and not plain[:1].isspace() and w == plain.split()[0] and not w[0].isalnum():
                continue  # punctuation right after a span belongs to its last word
            words.append(w)
            tags.append(TAGS.index(kind))
    return words, tags


class Field:
    """Weights: one row per feature and place (before, at, after a word), and transitions."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        self.forms: dict[str, np.ndarray] = {}
        gain = (move[:, 1:, None] + move[None, 1:, :].transpose(0, 1, 2)).max()
        self.slack = float(gain - (move[:, :1].min() + move[:1, :].min()))

    def form_scores(self, form: str) -> np.ndarray:
        """Scores a shape gives the word after, the word itself and the word before: 3 x tags."""
        ids = [self.index[f] for f in features(form) if f in self.index]
        return self.emit[:, ids].sum(axis=1)


def scores(field: Field, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Emission scores of a sequence of shape numbers; ``table`` is shapes x 3 x tags."""
    e = table[ids, 1].copy()
    e[1:] += table[ids[:-1], 0]
    e[:-1] += table[ids[1:], 2]
    return e


def viterbi(e: np.ndarray, move: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best paths of padded sequences (batch x time x tags) that start after and end before plain words."""
    n, steps, k = e.shape
    best = e[:, 0] + move[0]
    back = np.zeros((n, steps, k), np.int8)
    last = best + move[:, 0]
    end = last.argmax(axis=1)
    for t in range(1, steps):
        via = best[:, :, None] + move
        back[:, t] = via.argmax(axis=1)
        best = via.max(axis=1) + e[:, t]
        now = length == t + 1
        end[now] = (best[now] + move[:, 0]).argmax(axis=1)
    path = np.zeros((n, steps), np.int8)
    tag = end
    for t in range(steps - 1, -1, -1):
        live = t < length
        path[live, t] = tag[live]
        step = live & (t > 0)
        tag = np.where(step, back[np.arange(n), t, tag], tag)
    return path


def train(lines=LABELLED, rounds: int = 150, rate: float = 0.3, penalty: float = 0.002) -> Field:
    """Maximum likelihood by gradient ascent over all labelled lines at once."""
    data = [labelled(x) for x in lines]
    index: dict[str, int] = {}
    for words, _ in data:
        for w in words:
            for f in features(shape(w)):
                index.setdefault(f, len(index))
    k, n, steps = len(TAGS), len(data), max(len(w) for w, _ in data)
    # For each place, which features each word of the padded batch has.
    cells = [[], [], []]
    for s, (words, _) in enumerate(data):
        for t, w in enumerate(words):
            for f in features(shape(w)):
                for place, at in ((0, t + 1), (1, t), (2, t - 1)):
                    if 0 <= at < len(words):
                        cells[place].append((s * steps + at, index[f]))
    cells = [np.array(c).reshape(-1, 2) for c in cells]
    length = np.array([len(w) for w, _ in data])
    gold = np.zeros((n, steps), int)
    for s, (_, tags) in enumerate(data):
        gold[s, : len(tags)] = tags
    mask = np.arange(steps) < length[:, None]
    emit, move = np.zeros((3, len(index), k)), np.zeros((k, k))
    sums = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    total = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    # The word before the first and after the last is plain.
    before = np.concatenate([np.zeros((n, 1), int), gold[:, :-1]], axis=1)
    for _ in range(rounds):
        e = np.zeros((n * steps, k))
        for place in range(3):
            np.add.at(e, cells[place][:, 0], emit[place][cells[place][:, 1]])
        e = e.reshape(n, steps, k)
        fore = np.zeros((n, steps, k))
        fore[:, 0] = e[:, 0] + move[0]
        for t in range(1, steps):
            fore[:, t] = np.where(mask[:, t, None], total(fore[:, t - 1][:, :, None] + move, 1) + e[:, t], 0)
        rear = np.zeros((n, steps, k))
        for t in range(steps - 1, -1, -1):
            ends = (length == t + 1)[:, None]
            nxt = total(move[None] + (e[:, t + 1] + rear[:, t + 1])[:, None, :], 2) if t + 1 < steps else 0
            rear[:, t] = np.where(ends, move[:, 0], nxt)
        norm = total(fore[:, 0] + rear[:, 0], 1)
        p = np.where(mask[..., None], np.exp(fore + rear - norm[:, None, None]), 0)
        miss = -p
        miss[np.arange(n)[:, None], np.arange(steps), gold] += mask
        up_emit = np.stack([np.zeros((len(index), k))] * 3)
        for place in range(3):
            np.add.at(up_emit[place], cells[place][:, 1], miss.reshape(-1, k)[cells[place][:, 0]])
        up_move = np.zeros((k, k))
        np.add.at(up_move, (before[mask], gold[mask]), 1)
        np.add.at(up_move, (gold[np.arange(n), length - 1], 0), 1)
        up_move[0] -= p[:, 0].sum(axis=0)
        up_move[:, 0] -= p[np.arange(n), length - 1].sum(axis=0)
        for t in range(1, steps):
            pair = fore[:, t - 1][:, :, None] + move + (e[:, t] + rear[:, t])[:, None, :] - norm[:, None, None]
            up_move -= np.exp(pair[mask[:, t]]).sum(axis=0)
        for w, up, s in ((emit, up_emit, sums[0]), (move, up_move, sums[1])):
            up = up - penalty * n * w
            s += up * up
            w += rate * up / np.sqrt(s)
    return Field(index, emit, move)


class Decoder:
    """Finds the spans of a field in texts, keeping the shapes of words that it has seen."""

    def __init__(self, field: Field):
        self.field, self.numbers, self.forms = field, {}, {}
        self.table = np.zeros((0, 3, len(TAGS)))

    def number(self, word: str) -> int:
        form = shape(word)
        key = form if len(form) <= LONGEST_CACHED else hashlib.sha256(form.encode("utf-8", "surrogatepass")).digest()
        n = self.forms.get(key)
        if n is None:
            n = self.forms[key] = len(self.forms)
            if n == len(self.table):
                self.table = np.concatenate([self.table, np.zeros((max(n, 1024), 3, len(TAGS)))])
            self.table[n] = self.field.form_scores(form)
        if len(word) <= LONGEST_CACHED:
            self.numbers[word] = n
        return n

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of the words of each text."""
        if len(self.numbers) > MOST_CACHED or len(self.forms) > MOST_FORMS:
            self.numbers.clear(), self.forms.clear()
        known, field = self.numbers, self.field
        ids = []
        for text in texts:
            words = text.split()
            ids.append(np.array([known[w] if w in known else self.number(w) for w in words], np.int64))
        out, parts = [], []
        for d, own in enumerate(ids):
            out.append(np.zeros(len(own), np.int8))
            if not len(own):
                continue
            e = scores(field, self.table, own)
            open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= field.slack)
            if len(open_):
                cut = np.flatnonzero(np.diff(open_) > 1) + 1
                for run in np.split(open_, cut):
                    parts.append((d, run[0], e[run[0] : run[-1] + 1]))
        parts.sort(key=lambda x: len(x[2]))
        for i in range(0, len(parts), 256):
            group = parts[i : i + 256]
            length = np.array([len(x[2]) for x in group])
            padded = np.zeros((len(group), length[-1], len(TAGS)))
            for j, x in enumerate(group):
                padded[j, : length[j]] = x[2]
            for (d, at, _), path, n in zip(group, viterbi(padded, field.move, length), length):
                out[d][at : at + n] = path[:n]
        return out

    def spans(self, text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
        if not tags.any():
            return []
        out, before = [], 0
        for m, tag in zip(TOKEN.finditer(text), tags.tolist()):
            if tag:
                word = m[0].rstrip(".,;:!?\"'") or m[0]
                if tag == before:
                    out[-1][2] = m.start() + len(word)
                else:
                    out.append([TAGS[tag], m.start(), m.start() + len(word)])
            before = tag
        return [tuple(x) for x in out]


def merged(base: list, more: list) -> list[tuple[str, int, int]]:
    """Base spans, and the others that touch none of them, by kind and start."""
    taken = sorted((s, e) for _, s, e in base)
    free = [x for x in more if not any(s < x[2] and x[1] < e for s, e in taken)]
    return sorted([*base, *free], key=lambda x: (KINDS.index(x[0]), x[1]))


def said(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind; spans that touch become one."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def finder(field: Field, mask: bool):
    def find(batches):
        decoder = Decoder(field)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                texts = [x if isinstance(x, str) else "" for x in part["text"].tolist()]
                base = [base_spans(t) for t in texts]
                full = [merged(b, decoder.spans(t, g)) for t, b, g in zip(texts, base, decoder.tags(texts))]
                if mask:
                    new = [None if old is None else masked(t, s) for old, t, s in zip(part["text"].tolist(), texts, full)]
                    yield part.assign(text=new)
                    continue
                counts = {f"n_{k}": [sum(x[0] == k for x in b) for b in base] for k in BASE}
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").tolist(), **counts,
                    "base_sha256": [hashlib.sha256(said(b).encode()).hexdigest() for b in base],
                    "spans": [said(s) for s in full],
                    "n_more": [len(s) - len(b) for s, b in zip(full, base)],
                }).astype({"doc_id": "Int64"})

    return find


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): counts and digest of the base spans, and all spans.

    Offsets are code points, ends exclusive. Null texts count as empty: no spans, the digest
    of the empty string. Null ids and repeated rows keep their rows. An empty table gives no
    rows. Columns not named here are left out. Texts are read whole.
    """
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        finder(field or train(), False), f"doc_id long, {counts}, base_sha256 string, spans string, n_more long"
    )


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of ``docs`` with every span in ``text`` replaced by its kind in brackets, and n_chars to match.

    Null and empty texts stay as they are, as do all other columns, whatever they are called.
    Null ids and repeated rows keep their rows; an empty table gives none. Texts are read whole.
    """
    out = docs.mapInPandas(finder(field or train(), True), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
