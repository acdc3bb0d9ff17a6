"""The library's functions for scripts: statements as objects, and a client that runs them and answers in plain values."""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import Future
from typing import Any, Union

from pyspark.sql import SparkSession

from sparkseek import inject, parser
from sparkseek import nodes as n
from sparkseek.embed import Embedder
from sparkseek.engine import Engine, Report
from sparkseek.errors import SeekError
from sparkseek.nodes import to_json
from sparkseek.routes import compiled


class Stmt:
    """A parsed statement. `shard_key` and `inject_filter` change it in place."""

    def __init__(self, tree: Any):
        self.tree = tree

    @property
    def shard_key(self) -> str | None:
        return inject.get_shard(self.tree)

    @shard_key.setter
    def shard_key(self, value: str | None) -> None:
        self.tree = inject.set_shard(self.tree, value)

    def inject_filter(self, field: str, op: str, value: Any) -> None:
        self.tree = inject.inject_filter(self.tree, field, op, value)

    def to_dict(self) -> dict[str, Any]:
        return to_json(self.tree)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


Query = Union[str, Stmt, Sequence[Union[str, Stmt]]]


def statements(source: str) -> list[Stmt]:
    return [Stmt(t) for t in parser.parse(source)]


def _trees(query: Query) -> list[Any]:
    if isinstance(query, str):
        return parser.parse(query)
    return [query.tree] if isinstance(query, Stmt) else [t for q in query for t in _trees(q)]


def compile_query(query: str | Stmt) -> dict[str, Any]:
    """Type, method, path and payload of one statement."""
    found = _trees(query)
    if len(found) != 1:
        raise SeekError("EXECUTION", "one statement is compiled at a time")
    return compiled(found[0])


def explain(query: str | Stmt) -> dict[str, Any]:
    """What one statement asks for, without running anything or knowing its collection."""
    found = _trees(query)
    if len(found) != 1:
        raise SeekError("EXECUTION", "one statement is explained at a time")
    s, out = found[0], compiled(found[0])
    out = {k: out[k] for k in ("stmt_type", "method", "path")}
    if isinstance(s, n.Query):
        out |= {"expression": type(s.expr).__name__, "collection": s.collection, "common_tables": len(s.ctes), "sources": len(s.prefetch), "filter": s.where is not None, "limit": s.limit, "offset": s.offset}
    return out


def answer(report: Report) -> dict[str, Any]:
    results = []
    for r in report.results:
        one: dict[str, Any] = {"statement": r.statement, "ok": r.ok, "seconds": r.seconds}
        if r.error is not None:
            one["error"] = {"code": r.error.code, "kind": r.error.kind, "message": r.error.message}
        elif r.data is not None:
            one["rows"] = [x.asDict(recursive=True) for x in r.data.collect()]
        results.append(one)
    return {"ok": report.ok, "succeeded": report.succeeded, "failed": report.failed, "results": results}


class Client:
    """Runs statements on the session's engine. `path` keeps the collections from one client to the next."""

    def __init__(self, path: str | None = None, embedder: Embedder | None = None, spark: SparkSession | None = None):
        self.engine = Engine(spark or SparkSession.builder.getOrCreate(), embedder, path)

    def execute(self, query: Query, *, on_error: str = "stop") -> dict[str, Any]:
        return answer(self.engine.execute(_trees(query), on_error))

    def execute_async(self, query: Query, *, on_error: str = "stop") -> Future:
        trees = _trees(query)
        return self.engine.background(lambda: answer(self.engine.execute(trees, on_error)))

    def explain(self, query: str | Stmt) -> dict[str, Any]:
        """`explain`, with Spark's plan for statements that read."""
        s = _trees(query)[0]
        return explain(query) | ({"plan": self.engine.plan_text(s)} if self.engine.reads(s) else {})

    def compile(self, query: str) -> dict[str, Any]:
        return compile_query(query)


def execute(query: Query, *, path: str | None = None, embedder: Embedder | None = None, on_error: str = "stop") -> dict[str, Any]:
    return Client(path, embedder).execute(query, on_error=on_error)


def execute_async(query: Query, *, path: str | None = None, embedder: Embedder | None = None, on_error: str = "stop") -> Future:
    return Client(path, embedder).execute_async(query, on_error=on_error)
