"""Rewriting of statements: a predicate that every branch must meet, and the shard key."""

from __future__ import annotations

import dataclasses
from typing import Any

from sparkseek import nodes as n
from sparkseek.errors import fail

_FILTERED = (n.Scroll, n.Count, n.Delete, n.ClearPayload, n.DeletePayload, n.DeleteVector, n.UpdatePayload)
_SHARDED = (*_FILTERED, n.Upsert, n.UpdateVector)


def _predicate(field: str, op: str, value: Any) -> Any:
    if field.lower() == "id":
        ids = tuple(value) if isinstance(value, (list, tuple)) else (value,)
        if op not in ("=", "!=", "in", "not in"):
            fail("VALIDATION-ID-PREDICATE", "an id is compared by =, !=, in or not in")
        return n.Not(n.IdIn(ids)) if op in ("!=", "not in") else n.IdIn(ids)
    if op in ("in", "not in"):
        found = n.In(field, tuple(value))
        return n.Not(found) if op == "not in" else found
    if op == "!=":
        return n.Not(n.Compare(field, "=", value))
    return n.Compare(field, op, value) if op in ("=", ">", ">=", "<", "<=") else fail("VALIDATION-FILTER-INJECT", f"unknown operator {op}")


def both(where: Any, more: Any) -> Any:
    if where is None:
        return more
    return n.And((*where.parts, more)) if isinstance(where, n.And) else n.And((where, more))


def _query(q: n.Query, more: Any) -> n.Query:
    """The predicate goes to every place rows come from. A PREFETCH's own WHERE takes the place of its source's, so it
    gets the predicate too, and only it."""
    prefetch = tuple(dataclasses.replace(p, source=_query(p.source, more) if isinstance(p.source, n.Query) else p.source, where=p.where if p.where is None else both(p.where, more)) for p in q.prefetch)
    ctes = tuple((k, _query(t, more)) for k, t in q.ctes)
    if isinstance(q.expr, n.Points):
        fail("VALIDATION-FILTER-INJECT", "POINTS takes no filter")
    return dataclasses.replace(q, where=both(q.where, more), prefetch=prefetch, ctes=ctes)


def inject_filter(statement: Any, field: str, op: str, value: Any) -> Any:
    """The statement with `field op value` ANDed in everywhere; an UPSERT gets the payload field, by = only."""
    if isinstance(statement, n.Query):
        return _query(statement, _predicate(field, op, value))
    if isinstance(statement, _FILTERED):
        return dataclasses.replace(statement, where=both(statement.where, _predicate(field, op, value)))
    if isinstance(statement, n.Upsert) and op == "=" and field.lower() != "id":
        points = tuple(dataclasses.replace(p, payload=(*((k, v) for k, v in p.payload if k != field), (field, value))) for p in statement.points)
        return dataclasses.replace(statement, points=points)
    return fail("VALIDATION-FILTER-INJECT", f"{type(statement).__name__} takes no filter")


def get_shard(statement: Any) -> str | None:
    return getattr(statement, "shard", None)


def set_shard(statement: Any, key: str | None) -> Any:
    if isinstance(statement, n.Query):
        prefetch = tuple(dataclasses.replace(p, source=set_shard(p.source, key)) if isinstance(p.source, n.Query) else p for p in statement.prefetch)
        return dataclasses.replace(statement, shard=key, prefetch=prefetch, ctes=tuple((k, set_shard(t, key)) for k, t in statement.ctes))
    if isinstance(statement, _SHARDED):
        return dataclasses.replace(statement, shard=key)
    return fail("VALIDATION-FILTER-INJECT", f"{type(statement).__name__} takes no shard key")
