"""Scores of vector columns against literal vectors: higher-order functions, folded left to right in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.nodes import Sparse


def array_of(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column, q: Column) -> Column:
    return _fold(F.zip_with(x, q, lambda a, b: a.cast("double") * b))


def norm(x: Column) -> Column:
    return F.sqrt(_fold(F.transform(x, lambda a: a.cast("double") * a.cast("double"))))


def dense_score(x: Column, q: Sequence[float], distance: str) -> Column:
    """The distance's own score; null if the sizes differ."""
    lit = array_of(q)
    if distance == "DOT":
        out = dot(x, lit)
    elif distance == "EUCLID":
        out = F.sqrt(_fold(F.zip_with(x, lit, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))
    elif distance == "MANHATTAN":
        out = _fold(F.zip_with(x, lit, lambda a, b: F.abs(a.cast("double") - b)))
    else:
        size = sum(float(v) * float(v) for v in q) ** 0.5
        own = norm(x)
        out = F.when((own == 0) | F.lit(size == 0), 0.0).otherwise(dot(x, lit) / (own * size))
    return F.when(F.size(x) == len(q), out)


def higher_is_better(distance: str) -> bool:
    return distance not in ("EUCLID", "MANHATTAN")


def max_sim(x: Column, q: Sequence[Sequence[float]], distance: str) -> Column:
    """Sum over the query's rows of the best score among the column's rows."""
    best = F.array_max if higher_is_better(distance) else F.array_min

    def one(row: Sequence[float]) -> Column:
        return best(F.transform(x, lambda d: dense_score(d, row, distance)))

    out = F.lit(0.0)
    for row in q:
        out = out + one(row)
    return F.when(F.size(x) > 0, out)


def sparse_score(x: Column, q: Sparse) -> Column:
    """Product over shared indices; null where none is shared."""
    weights = F.create_map(*(F.lit(v) for i, w in zip(q.indices, q.values) for v in (i, float(w))))
    parts = F.zip_with(x["indices"], x["values"], lambda i, v: v.cast("double") * F.try_element_at(weights, i))
    hits = F.filter(parts, lambda p: p.isNotNull())
    return F.when(F.size(hits) > 0, _fold(hits))
