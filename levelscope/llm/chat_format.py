"""Chat formatting: heterogeneous records to canonical turns to marked-up training text.

A record is a JSON object. Its fingerprint is the hash of its sorted nested field paths
(array elements count as ``[]``); the fingerprint selects a declarative mapping, a list of
turns each with a role and the path of its text, or the path of an array of messages with
the names of their role and text fields. Records are mapped one by one: a conversation may
lie in one record or be spread over many, and no group of rows is brought together.

Turns are written as ``<|im_start|>{role}\\n{text}<|im_end|>\\n``. Control strings inside a
role or text are escaped reversibly: every ``\\`` becomes ``\\\\`` and every ``<|`` becomes
``<\\|``, so a marker can only be a real one. The loss mask covers the text of assistant
turns; spans are code points of the formatted turn.

Nulls and ties: a null text or role is empty; a null record, broken JSON and a fingerprint
without a mapping give no turns and are returned by ``unmapped``. Repeated turns are kept.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: ``turns`` of (role, path), or ``messages`` at a path.

    ``example`` is a record of the layout; its field paths are the layout's. ``optional``
    texts that are empty give no turn.
    """

    name: str
    example: dict
    conv_id: str
    turn: str | None = None
    turns: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role_field: str = "role"
    text_field: str = "content"
    optional: tuple[str, ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.example)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, the leaves only."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at + "[]"} if isinstance(value, list) else {at}


def fingerprint(record: dict) -> str:
    return hashlib.sha256("\n".join(sorted(paths(record))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def find(record, path: str):
    for step in path.split("."):
        record = record.get(step) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


#: Layouts known by default.
MAPPINGS = (
    Mapping("prompt", {"id": 1, "turn": 0, "prompt": ""}, "id", "turn", (("user", "prompt"),)),
    Mapping("prompt-completion", {"id": 1, "prompt": "", "completion": ""}, "id", None, (("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", {"id": 1, "instruction": "", "input": "", "output": ""}, "id", None, (("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping("response", {"meta": {"conversation": 1, "turn": 0}, "output": {"text": ""}}, "meta.conversation", "meta.turn", (("assistant", "output.text"),)),
    Mapping("messages", {"id": 1, "turn": 0, "messages": [{"role": "", "content": ""}]}, "id", "turn", messages="messages"),
    Mapping("conversation", {"id": 1, "conversations": [{"from": "", "value": ""}]}, "id", None, messages="conversations", role_field="from", text_field="value"),
)


def to_turns(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role and text of each record whose fingerprint has a mapping."""
    by_print = {m.fingerprint: m for m in mappings}

    def mapped(batches):
        for batch in batches:
            rows = []
            for raw in batch[column]:
                record = _parsed(raw)
                m = by_print.get(fingerprint(record)) if record is not None else None
                if m is None:
                    continue
                first = find(record, m.turn) if m.turn else 0
                if m.messages:
                    found = [(x.get(m.role_field), x.get(m.text_field)) for x in find(record, m.messages)]
                else:
                    found = [(role, find(record, path)) for role, path in m.turns if path not in m.optional or find(record, path)]
                conv = find(record, m.conv_id)
                rows += [(conv, (first or 0) + k, _text(role), _text(text)) for k, (role, text) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return records.select(column).mapInPandas(mapped, TURNS)


def _parsed(raw) -> dict | None:
    try:
        record = json.loads(raw) if raw else None
    except ValueError:
        return None
    return record if isinstance(record, dict) else None


def unmapped(records: DataFrame, column: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The records that no mapping fits, with their fingerprint (null for no JSON object)."""
    known = {m.fingerprint for m in mappings}

    def left(batches):
        for batch in batches:
            rows = [(raw, fingerprint(r) if (r := _parsed(raw)) is not None else None) for raw in batch[column]]
            yield pd.DataFrame([x for x in rows if x[1] not in known], columns=["record", "fingerprint"], dtype=object)

    return records.select(column).mapInPandas(left, "record string, fingerprint string")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: a single backslash after ``<`` was put there, all others are doubled."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """``escape`` for the head's one line: a line feed becomes ``<\\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_start and loss_end (code points; null off the mask)."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    start = F.when(F.col("role") == "assistant", F.length(head))
    return turns.select("conv_id", "turn", F.concat(head, text, F.lit(END + "\n")).alias("formatted"), start.alias("loss_start"), (start + F.length(text)).alias("loss_end"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Turns as the formatted text alone gives them, and the unescaped text under its mask."""
    body = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(END) + 1})")
    cut = F.expr("position('\n' IN body)")
    masked = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    return (
        formatted.withColumn("body", body)
        .withColumn("cut", cut)
        .select(
            "conv_id",
            "turn",
            unescape_role(F.expr("substring(body, 1, cut - 1)")).alias("role"),
            unescape(F.expr("substring(body, cut + 1)")).alias("text"),
            unescape(masked).alias("loss_text"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def digests(turns: DataFrame) -> DataFrame:
    """A row a conversation from ``read_turns``; rows stream in order, none are gathered."""

    def digest(batches):
        state: list = []

        def row():
            key, n, whole, loss_chars, loss, chars = state
            return key, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            rows = []
            for conv, role, text, loss_text, chars in zip(batch["conv_id"], batch["role"], batch["text"], batch["loss_text"], batch["formatted_chars"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if not state or state[0] != conv:
                    if state:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss_text is not None:
                    state[3] += len(loss_text)
                    state[4].update(loss_text.encode("utf-8", "surrogatepass"))
                state[5] += int(chars)
            yield _digest_frame(rows)
        if state:
            yield _digest_frame([row()])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64"})
