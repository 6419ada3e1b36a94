"""Chat records of many layouts, as canonical turns and formatted text.

The fingerprint of a record is a hash of its nested field paths. It selects a declarative mapping
from that layout to turns of a role and a text. A template marks the turns with control strings;
a text that contains a control string, or the escape character, is escaped, so the formatted text
can be read back to the same turns. The loss mask is the spans of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm._store import map_arrow

#: Opening and closing control strings by role; another role is named between TURN and TEXT.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<|assistant|>", "</s>")}
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
START = "<s>"
ESCAPE = "\\"
CONTROLS = (START, TURN, TEXT, END, *(x for pair in ROLES.values() for x in pair))
LEARNED_ROLE = "assistant"

Turn = tuple[str, str]


@dataclass(frozen=True)
class Layout:
    """Field paths, and where turns are: fields with fixed roles in order, or a list of turns."""

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()  # (path, role)
    turns: str = ""  # path of the list
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()  # what a role is called here, and canonically


#: The layouts known by default. A list without elements has the path of the list alone.
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout("messages, none", ("messages[]",), turns="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt and response", ("prompt", "response"), (("prompt", "user"), ("response", "assistant"))),
    Layout("prompt and completion", ("prompt", "completion"), (("prompt", "user"), ("completion", "assistant"))),
    Layout("question and answer", ("data.question", "data.answer"), (("data.question", "user"), ("data.answer", "assistant"))),
    Layout("instruction and output", ("instruction", "output"), (("instruction", "user"), ("output", "assistant"))),
    Layout("instruction, input and output", ("instruction", "input", "output"), (("instruction", "system"), ("input", "user"), ("output", "assistant"))),
    Layout("system, prompt and response", ("system", "prompt", "response"), (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
)


def paths(value: object, at: str = "") -> set[str]:
    """The field paths of a JSON value; lists add ``[]``."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(names: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(names)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _get(record: object, path: str) -> str:
    for key in path.split("."):
        record = record[key]
    return record if isinstance(record, str) else "" if record is None else json.dumps(record, ensure_ascii=False)


def canonical(record: object, layout: Layout) -> list[Turn]:
    """The turns of a record; null texts and roles are empty, and other values their JSON."""
    if not layout.turns:
        return [(role, _get(record, path)) for path, role in layout.fields]
    roles = dict(layout.roles)
    for key in layout.turns.split("."):
        record = record[key]
    out = []
    for x in record:
        role = _get(x, layout.role) if layout.role in x else ""
        out.append((roles.get(role, role), _get(x, layout.text) if layout.text in x else ""))
    return out


_CONTROL = "|".join(map(re.escape, CONTROLS))
_BEFORE_CONTROL = re.compile(f"(?={_CONTROL})")
_TOKEN = re.compile(rf"\\(.)|({_CONTROL})|[^\\<\[]+|[<\[]", re.DOTALL)


def escape(text: str) -> str:
    """An escape character before every escape character and wherever a control string begins."""
    return _BEFORE_CONTROL.sub(r"\\", text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of the assistant's escaped texts in it)."""
    out, spans, size = [START], [], len(START)
    for role, text in turns:
        body = escape(text)
        opening, closing = ROLES.get(role) or (TURN + escape(role) + TEXT, END)
        if role == LEARNED_ROLE:
            spans.append((size + len(opening), size + len(opening) + len(body)))
        out += (opening, body, closing)
        size += len(opening) + len(body) + len(closing)
    return "".join(out), spans


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted text."""
    opened = {o: (role, c) for role, (o, c) in ROLES.items()}
    turns: list[Turn] = []
    role, closing, held = None, None, []
    for m in _TOKEN.finditer(formatted):
        control = m[2]
        if control is None:
            held.append(m[1] if m[1] is not None else m[0])
        elif control in opened:
            role, closing = opened[control]
            held = []
        elif control == TEXT:
            role, closing, held = "".join(held), END, []
        elif control in (START, TURN):
            held = []
        elif control == closing:
            turns.append((role, "".join(held)))
            held = []
        else:
            raise ValueError(f"{control} at {m.start()} closes nothing")
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _format(layouts: tuple[Layout, ...]):
    by_print = {fingerprint(x.paths): x for x in layouts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("record").to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    rows.append((None, None, None, None, None))
                    continue
                key = fingerprint(paths(record))
                if (layout := by_print.get(key)) is None:
                    rows.append((key, None, None, None, None))
                    continue
                turns = canonical(record, layout)
                formatted, spans = render(turns)
                rows.append((key, layout.name, [{"role": r, "text": t} for r, t in turns], formatted, [{"start": a, "end": b} for a, b in spans]))
            kinds = (pa.string(), pa.string(), _TURNS, pa.string(), _SPANS)
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", "fingerprint", "layout", "turns", "formatted", "loss_spans"])

    return run


def format_chats(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Per row of ``records`` (id, record as JSON text): id, fingerprint, layout, turns, formatted, loss_spans.

    A record that is null or no JSON object has nulls but for its id; one of an unknown layout has
    its fingerprint, so that a mapping can be added. ``loss_spans`` count code points. Repeated
    rows are formatted alike; other columns aren't read; an empty table gives an empty result.
    """
    kind = dict(records.dtypes)["id"]
    schema = f"id {kind}, fingerprint string, layout string, turns array<struct<role:string,text:string>>, formatted string, loss_spans array<struct<start:long,end:long>>"
    return map_arrow(records.select("id", "record"), _format(layouts), schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            if formatted is None:
                rows.append((None,) * 5)
                continue
            turns = parse(formatted)
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((len(turns), said, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *cols], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted texts of ``format_chats`` say: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = dict(chats.dtypes)["id"]
    return map_arrow(chats.select("id", "formatted", "loss_spans"), _read_back, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_records(conversations: DataFrame) -> DataFrame:
    """(id, record) of a table (conv_id, turn, role, text) with a row per turn.

    A conversation is gathered whole, since its record is. Turns are ordered by turn, then role,
    then text; null roles and texts count as empty. A user's and an assistant's turn make a prompt
    and a response; with a system's turn before, instruction, input and output; others are lists
    of messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])

    def is_(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    def text(k: int) -> Column:
        return F.get("t", k)["text"]

    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    )
    return gathered.select(F.col("conv_id").alias("id"), record.alias("record"))
