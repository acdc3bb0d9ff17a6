"""Scroll, count, and changes of points."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek import nodes as n
from sparkseek.embed import Embedder
from sparkseek.errors import fail
from sparkseek.functions.filters import compile_filter
from sparkseek.operators.fuse import small
from sparkseek.plans.query import Planner
from sparkseek.plans.resolve import only, role
from sparkseek.semantics import DENSE, DENSE_SIZE, IMAGE, IMAGE_FIELDS, IMPLICIT_FIELDS, MULTI, MULTI_SIZE, SPARSE, TEXT_FIELDS
from sparkseek.sources.catalog import ID_TYPE, PAYLOAD, VECTOR_TYPES, Catalog, Collection, VectorDef, vector_value


def scroll(planner: Planner, s: n.Scroll) -> DataFrame:
    """A page by key: LIMIT points from AFTER on (it is the first of the page), all payload."""
    c = planner.catalog.get(s.collection)
    rows = planner.base(c, s.where, s.shard)
    if s.after is not None:
        rows = rows.where(F.col("__id") >= c.id_literal(s.after))
    return planner.project(c, rows.orderBy("__id").limit(s.limit), None, s.vectors, scored=False)


def next_cursor(planner: Planner, s: n.Scroll) -> Any:
    """The id that the next page starts with, or None. One row is read."""
    c = planner.catalog.get(s.collection)
    rows = planner.base(c, s.where, s.shard)
    if s.after is not None:
        rows = rows.where(F.col("__id") >= c.id_literal(s.after))
    found = rows.select("__id").orderBy("__id").limit(s.limit + 1).select(c.id_output().alias("id")).offset(s.limit).collect()
    return found[0][0] if found else None


def count(planner: Planner, s: n.Count) -> DataFrame:
    c = planner.catalog.get(s.collection)
    return planner.base(c, s.where, s.shard).agg(F.count(F.lit(1)).alias("count"))


# --- embeddings of an upsert ----------------------------------------------------------------------------------


def _text(point: n.Point, field: str | None, fields: tuple[str, ...]) -> str | None:
    payload = dict(point.payload)
    for key in (field,) if field else fields:
        if isinstance(payload.get(key), str):
            return payload[key]
    return None


def conventional(catalog: Catalog, name: str, u: n.Upsert) -> Collection:
    """The collection that an upsert of texts makes: a dense and a sparse vector."""
    dense = next((e.into for e in u.embeddings if e.kind in ("dense", "hybrid") and e.into), DENSE)
    sparse = next((e.sparse_into if e.kind == "hybrid" else e.into for e in u.embeddings if e.kind in ("sparse", "hybrid")), None) or SPARSE
    return catalog.empty(name, {dense: VectorDef("dense", DENSE_SIZE), sparse: VectorDef("sparse", idf=True)})


def _specs(c: Collection, u: n.Upsert) -> list[tuple[str, n.Embedding, str | None]]:
    """(vector, embedding, model) for all that is embedded."""
    out = []
    for e in u.embeddings:
        if e.kind == "hybrid":
            out.append((only(c, e.into, "dense"), e, e.model))
            out.append((only(c, e.sparse_into, "sparse"), e, e.sparse_model))
            continue
        if e.into is None and e.kind in ("multi", "image"):
            name = MULTI if e.kind == "multi" else IMAGE
        else:
            name = e.into if e.into is not None else only(c, None, e.kind)
        if name not in c.vectors:
            fail("EMBEDDING-TARGET", f"{c.name} has no vector {name}")
        has_multi = any(d.kind == "multi" for d in c.vectors.values())
        if role(c.vectors[name].kind) != role(e.kind) or e.kind == "multi" and c.vectors[name].kind != "multi" and has_multi:
            fail("EMBEDDING-TARGET", f"{name} is {c.vectors[name].kind}")
        out.append((name, e, e.model))
    if not u.embeddings and any(not p.vectors and _text(p, None, IMPLICIT_FIELDS) is not None for p in u.points):
        for kind in ("dense", "sparse"):
            names = [k for k, d in c.vectors.items() if d.kind == kind]
            if len(names) > 1:
                fail("EMBEDDING-TOPOLOGY", f"several {kind} vectors")
            out += [(k, n.Embedding(kind), None) for k in names]
    return out


def _joint(c: Collection, specs: list, embedder: Embedder, done: dict, texts: tuple[str, ...], model: str | None, kind: str) -> list | None:
    """The vectors of one kind from a single pass of a model that makes dense, sparse and multi-vectors together, if the
    embedder has one and the same model is asked for all three of the same field."""
    if type(embedder).joint is Embedder.joint or kind == "image":
        return None
    parts: dict[str, VectorDef] = {}
    for name, e, m in specs:
        if m == model and e.kind != "image":
            d = c.vectors[name]
            parts.setdefault("multi" if d.kind == "multi" and e.kind == "multi" else "sparse" if d.kind == "sparse" else "dense", d)
    if set(parts) != {"dense", "sparse", "multi"}:
        return None
    if (texts, model) not in done:
        done[texts, model] = dict(zip(("dense", "sparse", "multi"), embedder.joint(list(texts), model, parts["dense"].size or DENSE_SIZE, parts["multi"].size or MULTI_SIZE)))
    return done[texts, model][kind]


def embedded(c: Collection, u: n.Upsert, embedder: Embedder) -> list[dict[str, Any]]:
    """For each point its vectors by name, as values of their columns."""
    out: list[dict[str, Any]] = []
    for p in u.points:
        found = {}
        for name, v in p.vectors:
            if name is None:
                fits = [k for k, d in c.vectors.items() if vector_value(d.kind, v) is not None and (d.kind == "multi") == (not isinstance(v, n.Sparse) and isinstance(v[0], tuple))]
                name = fits[0] if len(fits) == 1 else fail("MISSING-USING", "say which vector by its name")
            if name not in c.vectors:
                fail("UNKNOWN-VECTOR", f"{c.name} has no vector {name}")
            found[name] = vector_value(c.vectors[name].kind, v)
            if found[name] is None:
                fail("VECTOR-KIND", f"{name} is {c.vectors[name].kind}")
        out.append(found)
    specs, joint = _specs(c, u), {}
    for name, e, model in specs:
        d = c.vectors[name]
        image = e.kind == "image"
        texts = [_text(p, e.field, IMAGE_FIELDS if image else TEXT_FIELDS) for p in u.points]
        todo = [i for i, t in enumerate(texts) if name not in out[i]]
        if any(texts[i] is None for i in todo):
            if not u.embeddings:  # not asked for: points without a text stay without the vector
                todo = [i for i in todo if texts[i] is not None]
            else:
                fail("EMBEDDING", f"a point has no field to embed into {name}")
        given = [texts[i] for i in todo]
        kind = "image" if image else "sparse" if d.kind == "sparse" else "multi" if e.kind == "multi" and d.kind == "multi" else "dense"
        made = _joint(c, specs, embedder, joint, tuple(given), model, kind)
        if made is None and kind == "sparse":
            made = embedder.sparse(given, model)
        elif made is None and kind == "image":
            made = embedder.image(given, model, d.size or DENSE_SIZE)
        elif made is None and kind == "multi":
            made = embedder.multi(given, model, d.size or MULTI_SIZE)
        elif made is None:
            made = embedder.dense(given, model, d.size or DENSE_SIZE)
        if len(made) != len(given):
            fail("EMBEDDING-MULTI" if d.kind == "multi" else "EMBEDDING-IMAGE" if image else "EMBEDDING", "the embedder returned another number of vectors")
        for i, v in zip(todo, made):
            out[i][name] = None if v is None else vector_value(d.kind, v if isinstance(v, n.Sparse) else tuple(tuple(r) if isinstance(r, (list, tuple)) else r for r in v))
    for found in out:
        for name, v in found.items():
            d = c.vectors[name]
            sizes = {len(v)} if d.kind == "dense" and v is not None else {len(r) for r in v} if d.kind == "multi" and v is not None else set()
            if d.size is not None and sizes - {d.size}:
                fail("VALIDATION-VECTOR", f"{name} has {d.size} numbers")
    return out


# --- changes --------------------------------------------------------------------------------------------------


def _stored(catalog: Catalog, c: Collection) -> None:
    if c.path is None:
        catalog.store(c, c.rows)


def plain(v: Any) -> Any:
    """A payload value as JSON has it."""
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, tuple) else v


def _typed_payload(c: Collection, payload: dict[str, Any]) -> dict[str, Any]:
    unknown = set(payload) - set(c.payload)
    if unknown:
        fail("VALIDATION-PAYLOAD", f"{c.name} has no field {sorted(unknown)[0]}")
    return payload


def upsert(catalog: Catalog, embedder: Embedder, u: n.Upsert) -> int:
    """Whole points take the place of those with the same id; of equal ids the last one counts."""
    if u.collection not in catalog.collections:
        texts = any(_text(p, None, IMPLICIT_FIELDS if not u.embeddings else TEXT_FIELDS) is not None for p in u.points)
        if not texts or u.embeddings and all(e.kind in ("multi", "image") for e in u.embeddings):
            catalog.get(u.collection)
        conventional(catalog, u.collection, u)
    c = catalog.get(u.collection)
    vectors = embedded(c, u, embedder)
    last = {(type(p.id), p.id): i for i, p in enumerate(u.points)}
    chosen = sorted(last.values())
    spark = catalog.spark
    ids = [c.id_value(u.points[i].id) for i in chosen]
    if any(v is None for v in ids):
        fail("VALIDATION-POINT-ID", f"ids of {c.name} are of another kind")
    if c.typed:
        for i in chosen:
            _typed_payload(c, dict(u.points[i].payload))
    _stored(catalog, c)
    fields = [f for f in c.schema if f.name.startswith("__v_")]
    raw = T.StructType([c.schema["__id"], T.StructField("payload", T.StringType()), T.StructField("shard", T.StringType()), *fields])
    rows = [(v, json.dumps({k: plain(x) for k, x in u.points[i].payload}), u.shard, *(vectors[i].get(f.name[4:]) for f in fields)) for v, i in zip(ids, chosen)]
    new = spark.createDataFrame(rows, raw)
    if c.typed:
        typed = T.StructType([f for f in c.schema if not f.name.startswith("__")])
        new = new.withColumn("p", F.from_json("payload", typed)).select("*", *(F.col(f"p.`{f.name}`") for f in typed))
    else:
        new = new.withColumn(PAYLOAD, F.parse_json("payload"))
    if "__shard" in c.rows.columns:
        new = new.withColumn("__shard", F.col("shard"))
    new = new.select(*(F.col(f"`{x}`") for x in c.rows.columns))
    wanted = spark.createDataFrame([(v,) for v in ids], T.StructType([c.schema["__id"]]))
    buckets = catalog.buckets_of(c, wanted)
    kept = catalog.part(c, buckets).join(small(wanted, len(ids)), "__id", "left_anti").select(*(F.col(f"`{x}`") for x in c.rows.columns))
    catalog.store(c, kept.unionByName(new), buckets)
    return len(chosen)


def _change(catalog: Catalog, c: Collection, where: Any, shard: str | None, change) -> None:
    """Rewrites the buckets that the filter can reach: `change` takes rows and the condition."""
    _stored(catalog, c)
    buckets = catalog.buckets_of(c, catalog.ids(c, where.ids)) if isinstance(where, n.IdIn) else sorted(c.manifest)
    rows = catalog.part(c, buckets)
    hit = F.coalesce(compile_filter(where, c.scope()), F.lit(False))
    if shard is not None:
        hit = hit & F.coalesce(F.col("__shard") == shard, F.lit(False)) if "__shard" in rows.columns else F.lit(False)
    catalog.store(c, change(rows, hit), buckets)


def _with(rows: DataFrame, hit, values: dict[str, Any]) -> DataFrame:
    """Columns set where the condition holds; the condition is on the rows as they were."""
    marked = rows.withColumn("__hit", hit)
    return marked.withColumns({k: F.when(F.col("__hit"), v).otherwise(F.col(f"`{k}`")) for k, v in values.items()}).drop("__hit")


def change(catalog: Catalog, s: Any) -> None:
    c = catalog.get(s.collection)
    null = lambda name: F.lit(None).cast(c.schema[name].dataType)
    if isinstance(s, n.Delete):
        _change(catalog, c, s.where, s.shard, lambda rows, hit: rows.where(~hit))
    elif isinstance(s, n.ClearPayload):
        values = {p: null(p) for p in c.payload} if c.typed else {PAYLOAD: F.parse_json(F.lit("{}"))}
        _change(catalog, c, s.where, s.shard, lambda rows, hit: _with(rows, hit, values))
    elif isinstance(s, n.DeletePayload):
        if c.typed:
            values = {p: null(p) for p in s.keys if p in c.payload}
        else:
            entries = F.from_json(F.to_json(PAYLOAD), "map<string,variant>")
            values = {PAYLOAD: F.parse_json(F.to_json(F.map_filter(entries, lambda k, _: ~k.isin(*s.keys))))}
        _change(catalog, c, s.where, s.shard, lambda rows, hit: _with(rows, hit, values))
    elif isinstance(s, n.DeleteVector):
        for name in s.names:
            if name not in c.vectors:
                fail("UNKNOWN-VECTOR", f"{c.name} has no vector {name}")
        _change(catalog, c, s.where, s.shard, lambda rows, hit: _with(rows, hit, {f"__v_{k}": null(f"__v_{k}") for k in s.names}))
    elif isinstance(s, n.UpdatePayload):
        new = {k: plain(v) for k, v in s.payload}
        if c.typed:
            _typed_payload(c, new)
            kind = T.StructType([c.schema[k] for k in new])
            values = {k: F.from_json(F.lit(json.dumps(new)), kind)[k] for k in new}
        else:  # keys are merged, the new ones win
            old = F.map_filter(F.from_json(F.to_json(PAYLOAD), "map<string,variant>"), lambda k, _: ~k.isin(*new))
            values = {PAYLOAD: F.parse_json(F.to_json(F.map_concat(old, F.from_json(F.lit(json.dumps(new)), "map<string,variant>"))))}
        _change(catalog, c, s.where, s.shard, lambda rows, hit: _with(rows, hit, values))
    elif isinstance(s, n.UpdateVector):
        name = s.name if s.name is not None else next(iter(c.vectors)) if len(c.vectors) == 1 else fail("MISSING-USING", "say which vector")
        if name not in c.vectors:
            fail("UNKNOWN-VECTOR", f"{c.name} has no vector {name}")
        d = c.vectors[name]
        value = vector_value(d.kind, s.vector)
        if value is None:
            fail("VECTOR-KIND", f"{name} is {d.kind}")
        if d.size is not None and d.kind == "dense" and len(value) != d.size:
            fail("VALIDATION-VECTOR", f"{name} has {d.size} numbers")
        made = F.from_json(F.lit(json.dumps(value)), VECTOR_TYPES[d.kind])
        _change(catalog, c, n.IdIn((s.id,)), s.shard, lambda rows, hit: _with(rows, hit, {f"__v_{name}": made}))
