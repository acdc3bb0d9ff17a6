"""Which vector a query means, and what its inputs are: before any row is read, but for points given by id."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.embed import Embedder
from sparkseek.errors import fail
from sparkseek.semantics import DENSE_SIZE, MULTI_SIZE
from sparkseek.sources.catalog import Collection, VectorDef


def role(kind: str) -> str:
    return "sparse" if kind == "sparse" else "dense"


def inputs_of(expr: Any) -> list[n.Input]:
    if isinstance(expr, (n.Nearest, n.Mmr, n.Rerank)):
        return [expr.input]
    if isinstance(expr, n.Context):
        return [i for p in expr.pairs for i in p]
    if isinstance(expr, n.Discover):
        return [expr.target, *(i for p in expr.pairs for i in p)]
    if isinstance(expr, n.Feedback):
        return [expr.target, *(i for i, _ in expr.items)]
    return []


def target(c: Collection, using: n.Target | None, expr: Any) -> tuple[str, VectorDef]:
    """Explicit name, else the only vector of the role that the inputs have, else the only vector."""
    structural = {"sparse" if isinstance(i.vector, n.Sparse) else "dense" for i in inputs_of(expr) if isinstance(i, n.VectorInput)}
    if any(isinstance(i, n.Image) for i in inputs_of(expr)):
        structural.add("dense")
    wanted = structural.pop() if len(structural) == 1 else None
    if using is not None:
        if using.name not in c.vectors:
            fail("UNKNOWN-VECTOR", f"{c.name} has no vector {using.name}")
        found = c.vectors[using.name]
        if using.kind and role(using.kind) != role(found.kind) or wanted and role(found.kind) != wanted:
            fail("VECTOR-KIND", f"{using.name} is {found.kind}")
        if using.kind == "multi" and found.kind != "multi":
            fail("VECTOR-KIND", f"{using.name} is {found.kind}")
        return using.name, found
    names = [k for k, v in c.vectors.items() if wanted is None or role(v.kind) == wanted]
    if len(names) != 1:
        fail("MISSING-USING", "say which vector by USING")
    return names[0], c.vectors[names[0]]


def only(c: Collection, name: str | None, wanted: str) -> str:
    """The named vector, or the only one of the role."""
    if name is not None:
        if name not in c.vectors:
            fail("UNKNOWN-VECTOR", f"{c.name} has no vector {name}")
        if role(c.vectors[name].kind) != wanted:
            fail("VECTOR-KIND", f"{name} is not {wanted}")
        return name
    names = [k for k, v in c.vectors.items() if role(v.kind) == wanted and (wanted == "sparse" or v.kind == "dense")]
    return names[0] if len(names) == 1 else fail("MISSING-USING", f"say which {wanted} vector")


def stored(c: Collection, name: str, ids: Sequence[n.PointId]) -> list[Any]:
    """The vectors of the points, in the order of ids; points without one are left out. One row an id."""
    if name not in c.vectors:
        fail("UNKNOWN-VECTOR", f"{c.name} has no vector {name}")
    rows = c.rows.where(c.id_in(tuple(ids))).select(c.id_output().cast("string").alias("id"), F.col(f"`__v_{name}`").alias("v")).collect()
    found = {r["id"]: r["v"] for r in rows if r["v"] is not None}
    return [found[str(i)] for i in ids if str(i) in found]


def vector_of(i: n.Input, c: Collection, name: str, embedder: Embedder, lookup: tuple[Collection, str] | None = None) -> Any:
    """A list of numbers, a list of such lists, or a Sparse, as the vector's kind needs."""
    d = c.vectors[name]
    if isinstance(i, n.PointInput):
        found = stored(*(lookup or (c, name)), [i.id])
        if not found:
            fail("POINT", f"point {i.id} has no vector")
        v = found[0]
        return n.Sparse(tuple(v["indices"]), tuple(v["values"])) if d.kind == "sparse" else v
    if isinstance(i, n.VectorInput):
        v = i.vector
        if d.kind == "multi" and not isinstance(v[0], tuple):
            return [list(v)]
        if d.kind == "dense" and v and isinstance(v[0], tuple):
            fail("VECTOR-KIND", f"{name} takes one vector")
    elif isinstance(i, n.Image):
        v = embedder.image([i.source], i.model, d.size or DENSE_SIZE)[0]
    elif d.kind == "sparse":
        v = embedder.sparse([i.text], i.model)[0] or n.Sparse((), ())
    elif d.kind == "multi":
        v = embedder.multi([i.text], i.model, d.size or MULTI_SIZE)[0]
    else:
        v = embedder.dense([i.text], i.model, d.size or DENSE_SIZE)[0]
    width = None if isinstance(v, n.Sparse) else len(v[0]) if d.kind == "multi" else len(v)
    if width is not None and d.size is not None and width != d.size:
        fail("VALIDATION-VECTOR", f"{name} has {d.size} numbers, the input {width}")
    return v
