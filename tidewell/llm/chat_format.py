"""Conversations as one text each, with a grammar that reads them back.

    conversation := turn*
    turn         := "### " role ": " text " </turn>\\n"

role is User, Assistant, System or any other with its own name. The parser is deterministic: a
header runs to the first ": ", a text to the first " </turn>\\n" whose mark is not escaped. A text that holds a
control string ("### " at the start of a header, "</turn>") gets a backslash before it, and before
any backslashes that stand there already, so that taking one backslash away restores it. Rendered
texts are parsed again and compared with the turns; while they differ, every control string and
backslash is escaped by code point (\\uXXXX;), until they are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
_NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_ROLES = {v: k for k, v in _NAMES.items()}
END = " </turn>\n"
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_ESCAPED = re.compile(r"\\(\\*)(### |</turn>)")
_HEADER = re.compile(r"### ((?:[^:\n\\]|\\u[0-9a-f]+;)*): ")
_CODED = re.compile(r"\\u([0-9a-f]+);")
_UNSAFE_ROLE = re.compile(r"[:\n\\]")
#: How a text is escaped; the last always reads back.
LIGHT, FULL = 0, 1


def escape(text: str, how: int = LIGHT) -> str:
    if how == LIGHT:
        return _CONTROL.sub(r"\\\1\2", text)
    return re.sub(r"[\\#<]", lambda m: f"\\u{ord(m[0]):x};", text)


def unescape(text: str, how: int = LIGHT) -> str:
    if how == LIGHT:
        return _ESCAPED.sub(r"\1\2", text)
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _role_out(role: str) -> str:
    if role in _NAMES:
        return _NAMES[role]
    out = _UNSAFE_ROLE.sub(lambda m: f"\\u{ord(m[0]):x};", role)
    return out if out not in _ROLES and out[:1] != "=" else f"\\u{ord(out[0]):x};{out[1:]}"


def _role_in(name: str) -> str:
    return _ROLES[name] if name in _ROLES else _CODED.sub(lambda m: chr(int(m[1], 16)), name)


def render_turn(role: str, text: str, how: int = LIGHT) -> str:
    return f"### {_role_out(role)}: {'=' if how == FULL else ''}{escape(text, how)}{END}"


@dataclass
class Parsed:
    role: str
    text: str
    #: Where the escaped text stands in the rendered one, end exclusive.
    start: int
    end: int


def parse(rendered: str) -> list[Parsed] | None:
    """The turns of a rendered conversation; None if it is not one. A text that is escaped in full begins with '='."""
    out, at = [], 0
    while at < len(rendered):
        head = _HEADER.match(rendered, at)
        if not head:
            return None
        start = head.end()
        end = rendered.find(END, start)
        if end < 0:
            return None
        raw = rendered[start:end]
        text = unescape(raw[1:], FULL) if raw[:1] == "=" else unescape(raw)
        out.append(Parsed(_role_in(head[1]), text, start, end))
        at = end + len(END)
    return out


def round_trip(role: str, text: str) -> tuple[str, Parsed]:
    """A turn rendered so that it reads back as it was, alone and so within any sequence of turns."""
    for how in (LIGHT, FULL):
        rendered = render_turn(role, text, how)
        back = parse(rendered)
        if back is not None and len(back) == 1 and (back[0].role, back[0].text) == (role, text):
            return rendered, back[0]
    raise ValueError(f"a turn of role {role!r} does not read back")


_TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_start int, loss_end int"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = [r or "" for r in batch.column(2).to_pylist()], [t or "" for t in batch.column(3).to_pylist()]
        done = [round_trip(r, t) for r, t in zip(roles, texts, strict=True)]
        masked = [p.role == "assistant" for _, p in done]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                batch.column(1).cast(pa.int64()),
                pa.array(roles, pa.string()),
                pa.array(texts, pa.string()),
                pa.array([r for r, _ in done], pa.string()),
                pa.array([p.start if m else 0 for (_, p), m in zip(done, masked, strict=True)], pa.int32()),
                pa.array([p.end if m else 0 for (_, p), m in zip(done, masked, strict=True)], pa.int32()),
            ],
            names=["conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end"],
        )


def format_turns(conversations: DataFrame) -> DataFrame:
    """Each turn rendered, with the span of its rendered text that the loss covers (assistant turns; else 0 to 0).

    The rendered conversation is its turns' rendered texts, joined in order. Null texts and roles are empty.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_render, _TURNS)



def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parts, mask, size = object(), [], [], 0

    def shut() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int64()), pa.array(["".join(parts)], pa.large_string()).cast(pa.string()), pa.array([[x for s in mask for x in s]], pa.list_(pa.int64()))],
            names=["conv_id", "formatted", "loss_spans"],
        )

    for batch in batches:
        for conv, rendered, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if parts:
                    yield shut()
                now, parts, mask, size = conv, [], [], 0
            if b > a:
                mask.append((size + a, size + b))
            parts.append(rendered)
            size += len(rendered)
    if parts:
        yield shut()


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation: its text, and start, end, start, end ... of what the loss covers.

    Turns are ordered by turn, nulls first, those alike by role and text. Rows with a null conv_id are one
    conversation. Further columns are not read. An empty table gives an empty one.
    """
    turns = format_turns(conversations)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    lined_up = turns.repartition("conv_id").sortWithinPartitions(*order)
    return lined_up.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(_join, "conv_id long, formatted string, loss_spans array<long>")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns = parse(text)
            if turns is None:
                raise ValueError(f"conversation {conv} does not read back")
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            starts = dict(zip(spans[::2], spans[1::2], strict=True))
            for t in turns:
                whole.update(f"{t.role}\n{t.text}\n".encode())
                if starts.get(t.start) == t.end:
                    loss.update(t.text.encode())
                    chars += len(t.text)
            rows.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of formatted conversations finds in them: turns, and the text under the loss mask, unescaped."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_back, _DIGEST)
