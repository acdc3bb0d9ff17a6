"""Tokens: names, numbers, strings and marks. Keywords are names; the parser tells them apart by place."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from sparkseek.errors import fail

_SKIP = re.compile(r"(?:[ \t\r\n]+|--[^\n]*)*")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:(?:\[\])?\.[A-Za-z_][A-Za-z0-9_$]*)*")
_NUMBER = re.compile(r"\d+(\.\d+)?([eE][+-]?\d+)?")
_PLAIN = re.compile(r"'([^'\\]*)'(?!')")  # a string without escapes
_MARK = re.compile(r"!=|>=|<=|[≠≥≤=<>(){}\[\],:;*+/.-]")
_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "n": "\n", "r": "\r", "t": "\t", "$": "$"}
_SAME = {"≠": "!=", "≥": ">=", "≤": "<="}


@dataclass(slots=True)
class Token:
    kind: str  # name, int, float, string, mark, end
    text: str
    value: Any
    start: int
    stop: int
    glued: bool = False  # whether it stands directly behind the token before
    key: str = ""  # of a name: in capitals, as keywords are


def _string(source: str, at: int) -> tuple[str, int] | None:
    """(value, end) of the string that starts here, if one does."""
    for quote in ("'''", '"""'):
        if source.startswith(quote, at):
            end = source.find(quote, at + 3)
            if end >= 0:
                return source[at + 3: end], end + 3
    raw = source[at] == "r" and source[at + 1: at + 2] in ("'", '"')
    if raw or source[at] == "`":
        begin = at + 2 if raw else at + 1
        end = source.find(source[begin - 1], begin)
        return (source[begin:end], end + 1) if end >= 0 else fail("LEX-STRING", "a string is not closed", (at, len(source)))
    quote = source[at]
    if quote not in "'\"":
        return None
    parts, i = [], at + 1
    while i < len(source):
        c = source[i]
        if c == "\\":
            if i + 1 >= len(source) or source[i + 1] not in _ESCAPES:
                fail("PARSE-ESCAPE", "unknown escape sequence", (i, i + 2))
            parts.append(_ESCAPES[source[i + 1]])
            i += 2
        elif c == quote:
            if quote == "'" and source[i + 1: i + 2] == "'":
                parts.append("'")
                i += 2
            else:
                return "".join(parts), i + 1
        else:
            parts.append(c)
            i += 1
    return fail("LEX-STRING", "a string is not closed", (at, len(source)))


def tokenize(source: str) -> list[Token]:
    """The tokens with an end token last. Spans are character offsets; `byte_span` turns them into bytes."""
    out: list[Token] = []
    at, size = 0, len(source)
    skip, name, number, mark, plain = _SKIP.match, _NAME.match, _NUMBER.match, _MARK.match, _PLAIN.match
    while True:
        begin = skip(source, at).end() if at < size and source[at] in " \t\r\n-" else at
        glued, at = begin == at and bool(out), begin
        if at >= size:
            out.append(Token("end", "", None, size, size))
            return out
        c = source[at]
        if c in "'\"`" or c == "r" and source[at + 1: at + 2] in ("'", '"'):
            if m := plain(source, at):
                value, end = m[1], m.end()
            else:
                value, end = _string(source, at)
            out.append(Token("string", source[at:end], value, at, end, glued))
        elif m := name(source, at):
            out.append(Token("name", m[0], m[0], at, m.end(), glued, m[0].upper()))
        elif m := number(source, at):
            after = source[m.end(): m.end() + 1]
            if after == "." or after.isalpha() or after == "_":
                fail("LEX-NUMBER", f"malformed number {m[0]}{after}", (at, m.end() + 1))
            real = m[1] or m[2]
            out.append(Token("float" if real else "int", m[0], float(m[0]) if real else int(m[0]), at, m.end(), glued))
        elif m := mark(source, at):
            if m[0] == "-" and source[m.end(): m.end() + 1] == "." or m[0] == "." and source[m.end(): m.end() + 1].isdigit():
                fail("LEX-NUMBER", "a number needs a digit before its point", (at, m.end() + 1))
            out.append(Token("mark", _SAME.get(m[0], m[0]), None, at, m.end(), glued))
        else:
            fail("LEX-CHAR", f"unexpected character {c!r}", (at, at + 1))
        at = out[-1].stop


def byte_span(source: str, start: int, stop: int) -> tuple[int, int]:
    return len(source[:start].encode()), len(source[:stop].encode())
