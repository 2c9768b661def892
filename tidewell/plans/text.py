"""SQL text as a sequence of code, literals, quoted names and comments."""

from __future__ import annotations

import re
from collections.abc import Iterator

_PART = re.compile(
    r"""(?P<literal>'(?:[^'\\]|\\.|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<code>[^'"`/-]+|[/-])""",
    re.S,
)
PLACEHOLDER = re.compile(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}")


def parts(sql: str) -> Iterator[tuple[str, str]]:
    """(kind, text) in order: code, literal, name or comment. An unclosed quote is code."""
    at = 0
    while at < len(sql):
        m = _PART.match(sql, at)
        if m:
            yield m.lastgroup, m[0]
            at = m.end()
        else:
            yield "code", sql[at]
            at += 1


def in_code(sql: str, change) -> str:
    """sql with change() applied to its code, all else as it was. Neighbouring code is one string."""
    out, code = [], []
    for kind, text in parts(sql):
        if kind == "code":
            code.append(text)
            continue
        out += [change("".join(code)), text]
        code = []
    return "".join([*out, change("".join(code))])


def statements(sql: str) -> list[str]:
    """The statements of a script, split at semicolons in code."""
    out, now = [], []
    for kind, text in parts(sql):
        pieces = text.split(";") if kind == "code" else [text]
        for i, piece in enumerate(pieces):
            if i:
                out.append("".join(now))
                now = []
            now.append(piece)
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


def split_arguments(text: str) -> list[str]:
    """Arguments at top-level commas."""
    out, now, depth = [], [], 0
    for kind, part in parts(text):
        if kind != "code":
            now.append(part)
            continue
        for c in part:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append("".join(now).strip())
                now = []
            else:
                now.append(c)
    return [*out, "".join(now).strip()] if now or out else []


def closing(sql: str, at: int) -> int:
    """The position of the parenthesis that closes the one at position at; -1 if none does."""
    depth, pos = 0, 0
    for kind, part in parts(sql):
        if kind == "code":
            for i, c in enumerate(part):
                if pos + i >= at:
                    depth += (c == "(") - (c == ")")
                    if depth == 0:
                        return pos + i
        pos += len(part)
    return -1
