"""Scores of a frame's rows for each kind of query expression. All are column expressions over literal vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.functions import vectors as v
from sparkseek.functions.text import document_weight, token_index, tokens, word_runs
from sparkseek.sources.catalog import Collection, VectorDef


def column(name: str) -> Column:
    return F.col(f"`__v_{name}`")


def _weight(total: int, seen: int) -> float:
    return math.log(1 + (total - seen + 0.5) / (seen + 0.5))


def _seen(c: Collection, name: str, terms: Sequence[Any], rows: DataFrame, holds: Callable[[Any], Column]) -> tuple[int, dict[Any, int]]:
    """The number of points and of those that hold each term, in one aggregate; kept until the collection changes."""
    kept = c.counts.setdefault((id(c.rows), name), {})
    missing = [t for t in dict.fromkeys(terms) if t not in kept]
    if missing or None not in kept:
        found = rows.agg(F.count(F.lit(1)), *(F.count_if(holds(t)) for t in missing)).first()
        kept[None] = found[0]
        kept.update(zip(missing, found[1:]))
    return kept[None], kept


def idf_weighted(c: Collection, name: str, q: n.Sparse) -> n.Sparse:
    """The query's weights times ln(1 + (N - n + 0.5) / (n + 0.5))."""
    if not q.indices:
        return q
    total, seen = _seen(c, name, q.indices, c.rows, lambda i: F.array_contains(column(name)["indices"], F.lit(i).cast("long")))
    return n.Sparse(q.indices, tuple(x * _weight(total, seen[i]) for i, x in zip(q.indices, q.values)))


def text_similarity(c: Collection, rows: DataFrame, name: str, d: VectorDef, q: n.Sparse, asked: str) -> tuple[DataFrame, Column]:
    """The sparse score of a text column against a text: only the query's own words are counted, by the JVM; the vectors
    themselves are not made."""
    words = {token_index(t): t for t in tokens(asked)}
    own = sorted(set(words.values()))
    counted = lambda df: df.withColumn("__words", word_runs(F.col(f"`__t_{name}`"))).withColumn("__hits", F.struct(F.size("__words").alias("size"), F.filter("__words", lambda t: t.isin(own)).alias("own")))
    if not own:
        return rows, F.lit(None).cast("double")
    weights = dict(zip(q.indices, q.values))
    if d.idf:
        total, seen = _seen(c, name, list(words), counted(c.rows), lambda i: F.array_contains("__hits.own", words[i]))
        weights = {i: w * _weight(total, seen[i]) for i, w in weights.items()}
    times_of = lambda word: F.size(F.filter("__hits.own", lambda t: t == word)).cast("double")
    score = F.lit(0.0)
    for i, w in sorted(weights.items()):
        times = times_of(words[i])
        score = score + F.lit(w) * F.when(times > 0, document_weight(times, F.col("__hits.size"), d.encoding)).otherwise(0.0)
    return counted(rows), F.when(F.size("__hits.own") > 0, score)


def similarity(name: str, d: VectorDef, q: Any) -> Column:
    """The vector's own score: larger is better unless its distance is EUCLID or MANHATTAN."""
    if d.kind == "sparse":
        return v.sparse_score(column(name), q) if q.indices else F.lit(None).cast("double")
    return v.max_sim(column(name), q, d.distance) if d.kind == "multi" else v.dense_score(column(name), q, d.distance)


def closeness(name: str, d: VectorDef, q: Any) -> Column:
    """The score turned so that larger is better."""
    s = similarity(name, d, q)
    return s if d.descending else -s


def average(positive: list[list[float]], negative: list[list[float]]) -> list[float]:
    """avg+ + avg+ - avg-, or avg+ without negatives."""
    mean = lambda rows: [sum(map(float, c)) / len(rows) for c in zip(*rows)]
    plus = mean(positive)
    return [2 * a - b for a, b in zip(plus, mean(negative))] if negative else plus


def best_score(name: str, d: VectorDef, positive: list, negative: list) -> Column:
    top = lambda qs: F.greatest(*[closeness(name, d, q) for q in qs]) if len(qs) > 1 else closeness(name, d, qs[0])
    plus = top(positive)
    if not negative:
        return plus
    minus = top(negative)
    return F.when(plus > minus, plus).otherwise(-(minus * minus))


def sum_scores(name: str, d: VectorDef, positive: list, negative: list) -> Column:
    out = F.lit(0.0)
    for q in positive:
        out = out + closeness(name, d, q)
    for q in negative:
        out = out - closeness(name, d, q)
    return out


def context(name: str, d: VectorDef, pairs: list[tuple[Any, Any]]) -> Column:
    """Each pair costs by how much the negative is closer."""
    out = F.lit(0.0)
    for a, b in pairs:
        out = out + F.least(closeness(name, d, a) - closeness(name, d, b), F.lit(0.0))
    return out


def discover(name: str, d: VectorDef, target: Any, pairs: list[tuple[Any, Any]]) -> Column:
    """Satisfied minus broken pairs, then closeness to the target between 0 and 1."""
    out = F.lit(1.0) / (F.lit(1.0) + F.exp(-closeness(name, d, target)))
    for a, b in pairs:
        out = out + F.signum(closeness(name, d, a) - closeness(name, d, b))
    return out


def feedback(name: str, d: VectorDef, target: Any, items: list[tuple[Any, float]], a: float, b: float, c: float) -> Column:
    """a * score, plus for each pair of examples confidence^b * c * delta."""
    out = F.lit(a) * closeness(name, d, target)
    for high, x in items:
        for low, y in items:
            if x > y:
                out = out + F.lit((x - y) ** b * c) * (closeness(name, d, high) - closeness(name, d, low))
    return out
