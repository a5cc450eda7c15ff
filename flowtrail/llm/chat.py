"""Chat formatting by schema fingerprint.

A record is JSON in one of several layouts. Its nested field paths are hashed; the
fingerprint picks a declarative mapping that turns the record into canonical turns. The
template marks turns with control strings and escapes those inside texts, so the output
can be read back exactly; the loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
OPEN, END = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
HEAD = re.compile(r"### (=?[A-Za-z0-9%_.~-]*): ")
STOP = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")

#: Layouts: field paths with what they lead to, and where the turns are. ``one`` lists (role,
#: field); ``each`` is (list, role field, text field, role names).
LAYOUTS = (
    {"paths": ("prompt:text", "response:text"), "one": (("user", "prompt"), ("assistant", "response"))},
    {"paths": ("prompt:text", "completion:text"), "one": (("user", "prompt"), ("assistant", "completion"))},
    {"paths": ("question:text", "answer:text"), "one": (("user", "question"), ("assistant", "answer"))},
    {"paths": ("instruction:text", "output:text"), "one": (("user", "instruction"), ("assistant", "output"))},
    {"paths": ("instruction:text", "input:text", "output:text"),
     "one": (("system", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"paths": ("messages[]", "messages[].role:text", "messages[].content:text"), "each": ("messages", "role", "content", {})},
    {"paths": ("conversations[]", "conversations[].from:text", "conversations[].value:text"),
     "each": ("conversations", "from", "value", {"human": "user", "gpt": "assistant"})},
)
#: The only path of what is no JSON.
BROKEN = "broken"


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record, leaves with their kind (null counts as text).

    List elements share one path; a list whose elements have different paths says so.
    """
    if isinstance(value, dict):
        found = {f"{at}{{}}"} if at else set()
        for k, v in value.items():
            name = quote(k, safe="", errors="surrogatepass")
            found |= paths(v, f"{at}.{name}" if at else name)
        return found - {f"{at}{{}}"} if at.endswith("[]") else found
    if isinstance(value, list):
        each = [paths(v, at + "[]") for v in value]
        return {at + "[]"}.union(*each, {at + "[]:uneven"} if any(x != each[0] for x in each) else ())
    kind = "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
    return {f"{at}:{kind}"}


def fingerprint(names) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


def parsed(record: str | None) -> tuple[object, str]:
    """A record and its fingerprint; null for what is no JSON or nested beyond reading."""
    try:
        value = json.loads(record) if isinstance(record, str) else None
        return value, fingerprint(paths(value))
    except (ValueError, RecursionError):
        return None, fingerprint([BROKEN])


def whole(text: str | None) -> str:
    """The text, empty for null, with halves of surrogate pairs replaced."""
    return (text or "").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


MAPPINGS = {fingerprint(x["paths"]): x for x in LAYOUTS}


def canonical(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "one" in mapping:
        return [(role, whole(record[field])) for role, field in mapping["one"]]
    name, role, text, roles = mapping["each"]
    return [(whole(roles.get(x[role], x[role])), whole(x[text])) for x in record[name]]


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of its loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{NAMES.get(role) or '=' + quote(role, safe='')}: "
        body = CONTROL.sub(lambda m: "\\" + m[0], text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def unescaped(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns, at = [], 0
    while at < len(text):
        head = HEAD.match(text, at)
        end = next(m for m in STOP.finditer(text, head.end()) if m[0] == END)
        name = head[1]
        turns.append((unquote(name[1:]) if name[:1] == "=" else ROLES[name], unescaped(text[head.end() : end.start()])))
        at = end.end()
    return turns


def writer(batches):
    for batch in batches:
        rows = []
        for record in batch["record"].tolist():
            value, mark = parsed(record)
            mapping = MAPPINGS.get(mark)
            if isinstance(value, dict) and value.get("messages") == []:
                mark, mapping = fingerprint(LAYOUTS[5]["paths"]), LAYOUTS[5]
            text, spans = formatted(canonical(value, mapping)) if mapping else (None, [])
            rows.append((mark, text, [{"start": s, "end": e} for s, e in spans]))
        made = pd.DataFrame(rows, columns=["layout", "formatted", "loss"])
        yield pd.concat([batch.drop(columns="record").reset_index(drop=True), made], axis=1)


def format_chat(records: DataFrame, key: str) -> DataFrame:
    """``key``, layout (fingerprint), formatted, loss (spans in code points) for every row of (key, record).

    ``record`` is JSON text. Null records, what is no JSON and unknown layouts, other kinds of
    values and lists with unlike elements among them, keep their fingerprint and get a null
    ``formatted``; null texts and roles count as empty; an empty list of messages gives an
    empty text. Repeated rows give repeated results, an empty table none.
    """
    kind = records.schema[key].dataType.simpleString()
    return records.select(key, "record").mapInPandas(
        writer, f"`{key}` {kind}, layout string, formatted string, loss array<struct<start:int,end:int>>"
    )


def reader(batches):
    for batch in batches:
        rows = []
        for text, loss in zip(batch["formatted"].tolist(), batch["loss"].tolist()):
            turns = read_back(text or "")
            said = "".join(unescaped(text[x["start"] : x["end"]]) for x in loss)
            rows.append((
                len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                len(said), hashlib.sha256(said.encode()).hexdigest(), len(text or ""),
            ))
        made = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield pd.concat([batch[["conv_id", "layout"]].reset_index(drop=True), made], axis=1)


def digests(chats: DataFrame) -> DataFrame:
    """What reading the formatted texts back gives."""
    return chats.mapInPandas(
        reader,
        "conv_id long, layout string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )


def records(turns: DataFrame) -> DataFrame:
    """Conversations stored as a row per turn, as one JSON record each (conv_id, record).

    A question and its answer become a prompt layout, a system text with one exchange an
    instruction layout, anything else a list of messages. Turns are ordered by number, role
    and text, those without a number first. A conversation is one output text, so its turns
    meet in one row; turns without a conversation are one of their own with a null id. Null
    roles and texts count as empty; repeated turns are turns; an empty table gives no rows.
    """
    said = turns.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    whole = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.concat_ws(",", F.col("t.role"))
    text = lambda i: F.col("t")[i]["text"]
    record = (
        F.when((F.size("t") == 2) & (roles == "user,assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(
            (F.size("t") == 3) & (roles == "system,user,assistant"),
            F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))),
        )
        .otherwise(
            F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
        )
    )
    return whole.select("conv_id", record.alias("record"))
