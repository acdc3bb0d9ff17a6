"""Declarative vector and hybrid retrieval on Spark."""

from __future__ import annotations

from sparkseek.client import Client, Stmt, compile_query, execute, execute_async, explain, statements
from sparkseek.errors import SeekError
from sparkseek.inject import get_shard, inject_filter, set_shard
from sparkseek.lexer import tokenize
from sparkseek.parser import is_valid, parse, parse_one

__version__ = "0.2.0"
__all__ = ["Client", "SeekError", "Stmt", "compile_query", "execute", "execute_async", "explain", "get_shard", "inject_filter", "is_valid", "parse", "parse_one", "set_shard", "statements", "tokenize"]
