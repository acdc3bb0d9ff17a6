"""Filters as boolean columns. A condition on a missing value is false, and NOT keeps exactly the other rows."""

from __future__ import annotations

import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.errors import fail
from sparkseek.functions import geo
from sparkseek.functions.fields import Scope, TypedScope, kind_of
from sparkseek.functions.text import word_list, words

_OPS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _literal(scope: Scope, field: str, value: Any) -> tuple[str, Column]:
    if isinstance(scope, TypedScope) and isinstance(value, str) and scope.is_time(field):
        return "timestamp", F.try_to_timestamp(F.lit(value))
    if isinstance(value, (dict, tuple)):
        fail("PARSE-LITERAL", "a comparison takes a scalar")
    return kind_of(value), F.lit(float(value) if isinstance(value, int) and value >= 1 << 63 else value)


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def compile_filter(node: Any, scope: Scope) -> Column:
    go = lambda x: compile_filter(x, scope)
    if isinstance(node, n.And):
        return reduce(operator.and_, map(go, node.parts))
    if isinstance(node, n.Or):
        return reduce(operator.or_, map(go, node.parts))
    if isinstance(node, n.Not):
        return ~_known(go(node.part))
    if isinstance(node, n.Compare):
        if node.value is None:
            return scope.null(node.field) if node.op == "=" else F.lit(False)
        kind, value = _literal(scope, node.field, node.value)
        return scope.any(node.field, kind, lambda c: _OPS[node.op](c, value))
    if isinstance(node, n.Between):
        kind, low = _literal(scope, node.field, node.low)
        _, high = _literal(scope, node.field, node.high)
        return scope.any(node.field, kind, lambda c: (c >= low) & (c <= high))
    if isinstance(node, n.In):
        by_kind: dict[str, list[Column]] = {}
        nulls = [scope.null(node.field)] if None in node.values else []
        for v in node.values:
            if v is not None:
                kind, value = _literal(scope, node.field, v)
                by_kind.setdefault(kind, []).append(value)
        return reduce(operator.or_, [_known(scope.any(node.field, k, lambda c, vs=vs: c.isin(*vs))) for k, vs in by_kind.items()] + nulls)
    if isinstance(node, n.IsNull):
        return scope.null(node.field)
    if isinstance(node, n.IsEmpty):
        return scope.empty(node.field)
    if isinstance(node, n.MatchText):
        asked = words(node.text)
        return scope.any(node.field, "string", lambda c: F.size(F.array_except(F.array(*map(F.lit, asked)), word_list(c))) == 0 if asked else F.lit(False))
    if isinstance(node, n.MatchPhrase):
        asked = " ".join(words(node.text))
        return scope.any(node.field, "string", lambda c: F.contains(F.concat(F.lit(" "), F.array_join(word_list(c), " "), F.lit(" ")), F.lit(f" {asked} ")) if asked else F.lit(False))
    if isinstance(node, n.IdIn):
        if scope.ids is None:
            fail("VALIDATION-ID-PREDICATE", "ids are not known here")
        return scope.ids(node.ids)
    if isinstance(node, n.Nested):
        return scope.any_object(node.path, lambda inner: _known(compile_filter(node.where, inner)))
    if isinstance(node, n.HasVector):
        return scope.vectors[node.name].isNotNull() if node.name in scope.vectors else F.lit(False)
    if isinstance(node, n.ValuesCount):
        return _OPS[node.op](scope.count(node.field), F.lit(node.count))
    if isinstance(node, n.GeoBox):
        return scope.any_geo(node.field, lambda a, b: geo.in_box(a, b, node.top_left, node.bottom_right))
    if isinstance(node, n.GeoRadius):
        return scope.any_geo(node.field, lambda a, b: geo.distance(a, b, node.center) <= node.radius)
    if isinstance(node, n.GeoPolygon):
        return scope.any_geo(node.field, lambda a, b: geo.in_polygon(a, b, node.exterior, node.interiors))
    return fail("PARSE-FILTER", f"no filter: {node!r}")

