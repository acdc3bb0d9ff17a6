"""The syntax tree. Every node is a frozen dataclass; rewriting copies with `dataclasses.replace`."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any, Union

PointId = Union[int, str]


def _node(cls):
    return dataclass(frozen=True)(cls)


# --- values ---------------------------------------------------------------------------------------------------


@_node
class Sparse:
    indices: tuple[int, ...]
    values: tuple[float, ...]


Vector = Union[tuple, Sparse]  # a dense vector, rows of dense vectors, or a sparse vector


@_node
class Geo:
    lat: float
    lon: float


# --- query inputs ---------------------------------------------------------------------------------------------


@_node
class Text:
    text: str
    model: str | None = None


@_node
class Image:
    source: str
    model: str | None = None


@_node
class VectorInput:
    vector: Vector


@_node
class PointInput:
    id: PointId


Input = Union[Text, Image, VectorInput, PointInput]


# --- filters --------------------------------------------------------------------------------------------------


@_node
class Compare:
    field: str
    op: str  # = > >= < <=
    value: Any


@_node
class Between:
    field: str
    low: Any
    high: Any


@_node
class In:
    field: str
    values: tuple


@_node
class IsNull:
    field: str


@_node
class IsEmpty:
    field: str


@_node
class MatchText:
    field: str
    text: str


@_node
class MatchPhrase:
    field: str
    text: str


@_node
class IdIn:
    ids: tuple[PointId, ...]


@_node
class Nested:
    path: str
    where: Any


@_node
class HasVector:
    name: str


@_node
class ValuesCount:
    field: str
    op: str
    count: int


@_node
class GeoBox:
    field: str
    top_left: Geo
    bottom_right: Geo


@_node
class GeoRadius:
    field: str
    center: Geo
    radius: float


@_node
class GeoPolygon:
    field: str
    exterior: tuple[Geo, ...]
    interiors: tuple[tuple[Geo, ...], ...] = ()


@_node
class And:
    parts: tuple


@_node
class Or:
    parts: tuple


@_node
class Not:
    part: Any


# --- formulas -------------------------------------------------------------------------------------------------


@_node
class Number:
    value: float


@_node
class Variable:
    name: str


@_node
class Binary:
    op: str  # + - * /
    left: Any
    right: Any
    default: float | None = None


@_node
class Call:
    name: str  # neg abs sqrt log ln exp pow
    args: tuple


@_node
class GeoDistance:
    origin: Geo
    field: str


@_node
class Matches:
    field: str
    values: tuple


@_node
class DateTime:
    text: str


@_node
class DateTimeKey:
    field: str


@_node
class Decay:
    kind: str  # exp gauss lin
    x: Any
    target: Any
    scale: Any
    midpoint: Any


@_node
class Case:
    where: Any
    then: Any
    otherwise: Any


# --- query expressions ----------------------------------------------------------------------------------------


@_node
class Nearest:
    input: Input


@_node
class Points:
    ids: tuple[PointId, ...]


@_node
class Recommend:
    positive: tuple[PointId, ...]
    negative: tuple[PointId, ...] = ()
    strategy: str = "average_vector"


@_node
class Context:
    pairs: tuple[tuple[Input, Input], ...]


@_node
class Discover:
    target: Input
    pairs: tuple[tuple[Input, Input], ...]


@_node
class OrderBy:
    field: str
    descending: bool = False


@_node
class Sample:
    pass


@_node
class Fusion:
    method: str  # rrf dbsf


@_node
class Formula:
    expr: Any
    defaults: tuple[tuple[str, Any], ...] = ()


@_node
class Feedback:
    target: Input
    items: tuple[tuple[Input, float], ...]
    a: float
    b: float
    c: float


@_node
class Mmr:
    input: Input
    diversity: float
    candidates: int


@_node
class Hybrid:
    text: Text
    dense: str | None = None
    sparse: str | None = None
    method: str = "rrf"


@_node
class Rerank:
    input: Input
    model: str


@_node
class CrossRerank:
    text: str
    model: str
    field: str = "text"


# --- queries --------------------------------------------------------------------------------------------------


@_node
class Target:
    name: str
    kind: str | None = None  # dense sparse multi


@_node
class Group:
    field: str
    size: int | None = None
    lookup: str | None = None


@_node
class Selector:
    """True, False, or names to include or exclude."""

    all: bool | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@_node
class Prefetch:
    source: Any  # the name of a common table or a Query
    where: Any = None
    threshold: float | None = None
    lookup: str | None = None
    lookup_vector: str | None = None


@_node
class Query:
    expr: Any
    collection: str | None
    using: Target | None = None
    prefetch: tuple[Prefetch, ...] = ()
    where: Any = None
    shard: str | None = None
    params: tuple[tuple[str, Any], ...] = ()
    threshold: float | None = None
    group: Group | None = None
    payload: Selector | None = None
    vectors: Selector | None = None
    limit: int | None = None
    offset: int | None = None
    ctes: tuple[tuple[str, Any], ...] = ()


# --- other statements -----------------------------------------------------------------------------------------


@_node
class Scroll:
    collection: str
    limit: int
    where: Any = None
    after: PointId | None = None
    shard: str | None = None
    vectors: Selector | None = None


@_node
class Count:
    collection: str
    where: Any = None
    shard: str | None = None
    exact: bool = True


@_node
class Embedding:
    kind: str  # dense sparse hybrid multi image, or auto
    model: str | None = None
    into: str | None = None
    field: str | None = None
    sparse_model: str | None = None
    sparse_into: str | None = None
    explicit: bool = False  # from EMBED


@_node
class Point:
    id: PointId
    vectors: tuple[tuple[str | None, Vector], ...]
    payload: tuple[tuple[str, Any], ...]


@_node
class Upsert:
    collection: str
    points: tuple[Point, ...]
    embeddings: tuple[Embedding, ...] = ()
    shard: str | None = None


@_node
class Delete:
    collection: str
    where: Any
    shard: str | None = None


@_node
class ClearPayload:
    collection: str
    where: Any
    shard: str | None = None


@_node
class DeletePayload:
    collection: str
    keys: tuple[str, ...]
    where: Any
    shard: str | None = None


@_node
class DeleteVector:
    collection: str
    names: tuple[str, ...]
    where: Any
    shard: str | None = None


@_node
class UpdatePayload:
    collection: str
    payload: tuple[tuple[str, Any], ...]
    where: Any
    shard: str | None = None


@_node
class UpdateVector:
    collection: str
    name: str | None
    vector: Vector
    id: PointId
    shard: str | None = None


@_node
class VectorSpec:
    name: str
    kind: str  # dense sparse multi
    size: int | None = None
    distance: str | None = None
    config: tuple[tuple[str, tuple], ...] = ()


@_node
class CreateCollection:
    name: str
    mode: str = "plain"  # plain dense hybrid hybrid_rerank
    model: str | None = None
    dense: str | None = None
    sparse: str | None = None
    vectors: tuple[VectorSpec, ...] = ()
    config: tuple[tuple[str, tuple], ...] = ()


@_node
class AlterCollection:
    name: str
    config: tuple[tuple[str, tuple], ...]


@_node
class DropCollection:
    name: str


@_node
class CreateIndex:
    collection: str
    field: str
    type: str | None = None
    options: tuple[tuple[str, Any], ...] = ()


@_node
class DropIndex:
    collection: str
    field: str


@_node
class CreateShardKey:
    key: str
    collection: str
    options: tuple[tuple[str, int], ...] = ()


@_node
class DropShardKey:
    key: str
    collection: str


@_node
class ShowCollections:
    pass


@_node
class ShowCollection:
    name: str


@_node
class ShowShardKeys:
    collection: str


def to_json(node: Any) -> Any:
    """A plain form of a tree: {"node": name, field: ...}."""
    if dataclasses.is_dataclass(node):
        return {"node": type(node).__name__} | {f.name: to_json(getattr(node, f.name)) for f in dataclasses.fields(node)}
    return [to_json(x) for x in node] if isinstance(node, tuple) else node
