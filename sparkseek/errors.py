"""Errors of the language and the engine: a kind, a stable code and, where known, a byte span of the source."""

from __future__ import annotations


class SeekError(Exception):
    def __init__(self, code: str, message: str, span: tuple[int, int] | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.span = code, message, span

    @property
    def kind(self) -> str:
        """lex, parse, validation, plan or execution."""
        head = self.code.split("-")[0].lower()
        return head if head in ("lex", "parse", "validation", "plan") else "execution"


def fail(code: str, message: str, span: tuple[int, int] | None = None):
    raise SeekError(code, message, span)
