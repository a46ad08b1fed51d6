"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths.

A record is JSON.  Its fingerprint is the hash of its sorted field paths (list items are
``[]``); it selects a declarative mapping that turns the layout into canonical turns (role,
text).  The template then writes ``<turn role>``, a line break, the text, ``</turn>`` and a
line break for each turn.  In roles and texts a backslash comes before each backslash,
``<`` and ``>``, so no control string can stand inside, and the text is read back exactly.

Rows by turn are records of one turn each, formatted one by one; a conversation is what its
rows give, in order.  It is never gathered: rows are dealt and sorted by conversation, and
digests are carried from row to row, so a conversation of any length takes little memory.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first), then
role, then text, and repeated rows stay; rows with a null conv_id form one conversation;
a layout without a mapping, or a record whose fields are not what its mapping needs (turns
that are no list of objects, or one that lacks a field), has the fingerprint reported and no
turns; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def field_paths(value, at: str = "") -> set[str]:
    """Paths of all leaves (and of empty lists and objects) of a JSON value."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: Layouts: the field paths, then either the list that holds turns with its role and text
#: fields (no list: the record is one turn), or a turn for each single field (role, field), in order.
LAYOUTS = (
    ({"role", "text"}, ("", "role", "text")),
    ({"role", "content"}, ("", "role", "content")),
    ({"messages[].role", "messages[].content"}, ("messages", "role", "content")),
    ({"messages"}, ("messages", "role", "content")),
    ({"conversations[].from", "conversations[].value"}, ("conversations", "from", "value")),
    ({"conversations"}, ("conversations", "from", "value")),
    ({"turns[].speaker", "turns[].text"}, ("turns", "speaker", "text")),
    ({"prompt", "completion"}, (("user", "prompt"), ("assistant", "completion"))),
    ({"prompt", "response"}, (("user", "prompt"), ("assistant", "response"))),
    ({"system", "prompt", "response"}, (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ({"question", "answer"}, (("user", "question"), ("assistant", "answer"))),
    ({"instruction", "output"}, (("user", "instruction"), ("assistant", "output"))),
    ({"instruction", "input", "output"}, (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}
#: Other names of the canonical roles, in layouts of the second kind of list.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

_TURN = re.compile(r"<turn ((?:[^\\>]+|\\.)*)>\n((?:[^\\<]+|\\.)*)</turn>\n", re.DOTALL)
_CONTROL = re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def canonical(record: str | None) -> tuple[str, list[tuple[str, str]] | None]:
    """Fingerprint and turns of a JSON record; None for turns where no mapping fits."""
    try:
        value = json.loads(record or "null")
    except ValueError:
        value = None
    own = fingerprint(field_paths(value))
    mapping = MAPPINGS.get(own) if isinstance(value, dict) else None
    if mapping is None:
        return own, None
    said = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x)
    if isinstance(mapping[0], str):
        name, role, text = mapping
        said_turns = value[name] if name else [value]
        if not isinstance(said_turns, list) or not all(isinstance(t, dict) and role in t and text in t for t in said_turns):
            return own, None
        named = (lambda x: ROLES.get(x, x)) if role != "role" else lambda x: x
        return own, [(named(said(t[role])), said(t[text])) for t in said_turns]
    return own, [(role, said(value[field])) for role, field in mapping if field != "input" or value[field]]


def write(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it (code points) that bear loss: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role)}>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``write`` was given."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [canonical(r) for r in b["record"]]
        out = [write(turns) if turns is not None else (None, []) for _, turns in found]
        yield pd.DataFrame({"conv_id": b["conv_id"], "layout": [x for x, _ in found], "formatted": [x for x, _ in out], "loss_spans": [[{"start": i, "stop": j} for i, j in s] for _, s in out]})


def format_records(records: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, loss_spans of records (conv_id, record: JSON), each on its own and in their order."""
    kind = records.schema["conv_id"].dataType
    named = records.select(F.col("conv_id").cast("string").alias("conv_id"), "record")
    found = named.mapInPandas(_formatted, "conv_id string, layout string, formatted string, loss_spans array<struct<start: long, stop: long>>")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def records_of(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as records of one turn, those of a conversation one after another in one partition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", F.to_json(F.struct("role", "text")).alias("record"))


class _Digest:
    """What is known of a conversation up to some row."""

    def __init__(self, conv: str | None):
        self.conv, self.n, self.turns, self.loss_chars, self.loss, self.chars = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0

    def add(self, formatted: str, spans) -> None:
        for role, text in read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for s in spans:
            text = unescape(formatted[s["start"] : s["stop"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each conversation, whose records follow one another."""
    names, now = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None
    for b in batches:
        done = []
        for conv, formatted, spans in zip(b["conv_id"].astype(object).where(b["conv_id"].notna(), None), b["formatted"], b["loss_spans"], strict=True):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = _Digest(conv)
            now.add(formatted, spans)
        if done:
            yield pd.DataFrame(done, columns=names)
    if now:
        yield pd.DataFrame([now.row()], columns=names)


def report(rows: DataFrame) -> DataFrame:
    """Contract rows, read back from what was formatted."""
    spark = rows.sparkSession
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
    formatted = format_records(records_of(own)).withColumn("conv_id", F.col("conv_id").cast("string"))
    found = formatted.mapInPandas(_digests, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


def dealt_layouts(rows: DataFrame) -> DataFrame:
    """Rows by turn as records (conv_id, record) of four layouts, a record for each two turns: messages, from and value, prompt and response, instruction.

    A user's and an assistant's turn take the layout whose turn it is for the conversation; other turns are messages.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = rows.select("conv_id", F.floor(F.col("turn") / 2).alias("k"), F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    x = own.groupBy("conv_id", "k").agg(F.array_sort(F.collect_list("t")).alias("t"))
    role, said = lambda i: F.col("t")[i]["role"], lambda i: F.col("t")[i]["text"]
    pair = (F.size("t") == 2) & (role(0) == "user") & (F.get("t", F.lit(1))["role"] == "assistant")
    kind = F.when(pair, F.pmod(F.col("conv_id"), F.lit(4))).otherwise(0)
    messages = F.to_json(F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    values = F.to_json(F.struct(F.array(F.struct(F.lit("human").alias("from"), said(0).alias("value")), F.struct(F.lit("gpt").alias("from"), F.get("t", F.lit(1))["text"].alias("value"))).alias("conversations")))
    prompt = F.to_json(F.struct(said(0).alias("prompt"), F.get("t", F.lit(1))["text"].alias("response")))
    instruction = F.to_json(F.struct(said(0).alias("instruction"), F.lit("").alias("input"), F.get("t", F.lit(1))["text"].alias("output")))
    return x.select("conv_id", F.when(kind == 1, values).when(kind == 2, prompt).when(kind == 3, instruction).otherwise(messages).alias("record"))


def layout_report(rows: DataFrame) -> DataFrame:
    """conv_id, layout (fingerprint), formatted_sha256, loss_chars of records of several layouts."""
    found = format_records(dealt_layouts(rows))
    loss = F.aggregate("loss_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("conv_id", "layout", F.sha2("formatted", 256).alias("formatted_sha256"), loss.alias("loss_chars"))
