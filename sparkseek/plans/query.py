"""From a query's tree to a DataFrame. Nothing runs but lookups of points named by id and, for sparse vectors with the
idf modifier, the counts of the query's terms."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.embed import Embedder
from sparkseek.errors import fail
from sparkseek.functions.fields import TypedScope
from sparkseek.functions.filters import compile_filter
from sparkseek.functions.formula import compile_formula
from sparkseek.operators import fuse, score
from sparkseek.plans import resolve
from sparkseek.semantics import DEFAULT_LIMIT, GROUP_LIMIT, GROUP_SIZE, HYBRID_FACTOR, HYBRID_UNLIMITED, RRF_K
from sparkseek.sources.catalog import PAYLOAD, Catalog, Collection

SEED = 7


@dataclass
class Ranked:
    """Rows of a collection's frame with __score, in an order that is total."""

    rows: DataFrame
    order: list[Column]
    descending: bool = True
    scored: bool = True
    worst: float | None = None

    def valid(self, rows: DataFrame) -> DataFrame:
        """Without those that have no score or one past the threshold. They are last in the order, so this is asked of
        rows that are cut already: asked before, the score would be computed in the filter and again in the projection."""
        if not self.scored:
            return rows
        rows = rows.where(F.col("__score").isNotNull())
        return rows if self.worst is None else rows.where(F.col("__score") >= self.worst if self.descending else F.col("__score") <= self.worst)


class Planner:
    def __init__(self, catalog: Catalog, embedder: Embedder, seed: int = SEED):
        self.catalog, self.embedder, self.seed = catalog, embedder, seed

    # --- entry points

    def query(self, q: n.Query) -> DataFrame:
        if isinstance(q.expr, n.CrossRerank):
            return self.cross_rerank(q)
        c = self.catalog.get(q.collection)
        if isinstance(q.expr, n.Points):
            rows = self.base(c, None, q.shard).where(c.id_in(q.expr.ids)).orderBy("__id")
            return self.project(c, rows, q.payload, q.vectors, scored=False)
        ranked = self.ranked(q, c)
        if q.group:
            return self.grouped(q, c, ranked)
        return self.project(c, self.page(ranked, q.limit, q.offset), q.payload, q.vectors, ranked.scored)

    def page(self, ranked: Ranked, limit: int | None, offset: int | None) -> DataFrame:
        rows = ranked.rows.orderBy(*ranked.order)
        return ranked.valid((rows.offset(offset) if offset else rows).limit(DEFAULT_LIMIT if limit is None else limit))

    # --- rows

    def base(self, c: Collection, where: Any, shard: str | None) -> DataFrame:
        rows = c.rows
        if shard is not None:
            if "__shard" not in rows.columns:
                fail("SHARD", f"{c.name} has no shard keys")
            rows = rows.where(F.col("__shard") == shard)
        return rows if where is None else rows.where(compile_filter(where, c.scope()))

    def by_score(self, rows: DataFrame, value: Column, descending: bool = True) -> Ranked:
        rows = rows.withColumn("__score", F.nanvl(value.cast("double"), F.lit(None).cast("double")))
        return Ranked(rows, [F.col("__score").desc_nulls_last() if descending else F.col("__score").asc_nulls_last(), F.col("__id").asc()], descending)

    def without(self, rows: DataFrame, c: Collection, inputs: list[n.Input], lookup: Any = None) -> DataFrame:
        """Points that a query names by id are no hits of it."""
        ids = tuple(i.id for i in inputs if isinstance(i, n.PointInput))
        return rows.where(c.id_not_in(ids)) if ids and lookup is None else rows

    def bound(self, q: n.Query) -> int:
        """The most rows that the sources of PREFETCH have together."""
        return sum(self.source(q, p).limit or DEFAULT_LIMIT for p in q.prefetch)

    def sources(self, q: n.Query, c: Collection) -> list[tuple[DataFrame, bool]]:
        out = []
        for p in q.prefetch:
            s = self.source(q, p)
            if isinstance(s.expr, (n.Points, n.CrossRerank)):
                fail("PLAN-UNSUPPORTED-PREFETCH", "POINTS and CROSS RERANK are no sources of PREFETCH")
            if s.group:
                fail("PLAN-PREFETCH-GROUP", "a source of PREFETCH has no GROUP BY")
            if s.collection not in (None, c.name):
                fail("PLAN-COLLECTION", "a source of PREFETCH is of the query's collection")
            lookup = None
            if p.lookup:
                other = self.catalog.get(p.lookup)
                lookup = (other, p.lookup_vector)
            ranked = self.ranked(s, c, lookup)
            out.append((self.page(ranked, s.limit, s.offset).select("__id", "__score"), ranked.descending))
        return out

    def source(self, q: n.Query, p: n.Prefetch) -> n.Query:
        """The source's query; WHERE and SCORE THRESHOLD of the PREFETCH take the place of its own."""
        if isinstance(p.source, n.Query):
            s = p.source
        else:
            found = [t for k, t in q.ctes if k.lower() == p.source.lower()]
            s = found[0] if found else fail("PLAN-PREFETCH-CTE", f"{p.source} is not defined")
        return dataclasses.replace(s, where=s.where if p.where is None else p.where, threshold=s.threshold if p.threshold is None else p.threshold)

    # --- expressions

    def ranked(self, q: n.Query, c: Collection, lookup: tuple[Collection, str | None] | None = None) -> Ranked:
        e = q.expr
        if isinstance(e, n.Hybrid):
            return self.threshold(self.hybrid(q, c), q)
        if isinstance(e, n.Fusion):
            if not q.prefetch:
                fail("PLAN-FUSION-PREFETCH", "FUSION needs PREFETCH")
            return self.threshold(self.fused(self.sources(q, c), e.method, dict(q.params), self.base(c, q.where, q.shard), self.bound(q)), q)
        rows, first = self.base(c, q.where, q.shard), None
        if q.prefetch:
            candidates = fuse.union(self.sources(q, c))
            if isinstance(e, n.Formula):
                # a point of several sources has the score of the first
                first = candidates.groupBy("__id").agg(F.min_by("__score", "__source").alias("__first"))
                rows = rows.join(fuse.small(first, self.bound(q)), "__id")
            else:
                rows = rows.join(fuse.small(candidates.select("__id").distinct(), self.bound(q)), "__id", "left_semi")
        if isinstance(e, n.OrderBy):
            return self.ordered(c, rows, e)
        if isinstance(e, n.Sample):
            return Ranked(rows.withColumn("__score", F.lit(0.0)).withColumn("__order", F.rand(self.seed)), [F.col("__order"), F.col("__id")], scored=False)
        if isinstance(e, n.Formula):
            defaults = {k: v for k, v in e.defaults}
            given = F.col("__first") if first is not None else F.lit(float(next((v for k, v in e.defaults if k in ("score", "$score")), 0.0)))
            return self.threshold(self.by_score(rows, compile_formula(e.expr, c.scope(), given, defaults)), q)
        return self.threshold(self.vector_query(q, c, rows, lookup), q)

    def threshold(self, r: Ranked, q: n.Query) -> Ranked:
        if q.threshold is None:
            return r
        if isinstance(q.expr, n.Mmr):  # not in the order of scores
            return dataclasses.replace(r, rows=r.rows.where(F.col("__score") >= q.threshold if r.descending else F.col("__score") <= q.threshold))
        return dataclasses.replace(r, worst=q.threshold)

    def ordered(self, c: Collection, rows: DataFrame, e: n.OrderBy) -> Ranked:
        scope = c.scope()
        found = scope.find(e.field) if isinstance(scope, TypedScope) else None
        if found is not None:
            key = found[0]
        elif isinstance(scope, TypedScope):
            key = F.lit(None).cast("string")
        else:  # numbers before texts
            number, text = scope.number(e.field), scope.text(e.field)
            key = F.when(text.isNotNull(), F.struct(number.isNull().alias("s"), number.alias("n"), text.alias("t")))
        rows = rows.withColumn("__key", key).where("__key is not null").withColumn("__score", F.lit(0.0))
        return Ranked(rows, [F.col("__key").desc() if e.descending else F.col("__key").asc(), F.col("__id").asc()], scored=False)

    def vector_query(self, q: n.Query, c: Collection, rows: DataFrame, lookup: tuple[Collection, str | None] | None) -> Ranked:
        e = q.expr
        name, d = resolve.target(c, q.using, e)
        at = None if lookup is None else (lookup[0], lookup[1] or name)
        get = lambda i: resolve.vector_of(i, c, name, self.embedder, at)
        inputs = resolve.inputs_of(e)
        rows = self.without(rows, c, inputs, lookup)
        if isinstance(e, n.Nearest) and isinstance(e.input, n.Text) and d.encoding is not None and type(self.embedder).sparse is Embedder.sparse:
            return self.by_score(*score.text_similarity(c, rows, name, d, get(e.input), e.input.text))
        rows = rows.where(score.column(name).isNotNull())
        if isinstance(e, n.Recommend):
            return self.recommend(c, rows, e, name, d, at)
        if isinstance(e, n.Context):
            return self.by_score(rows, score.context(name, d, [(get(a), get(b)) for a, b in e.pairs]))
        if isinstance(e, n.Discover):
            return self.by_score(rows, score.discover(name, d, get(e.target), [(get(a), get(b)) for a, b in e.pairs]))
        if isinstance(e, n.Feedback):
            return self.by_score(rows, score.feedback(name, d, get(e.target), [(get(i), s) for i, s in e.items], e.a, e.b, e.c))
        if isinstance(e, n.Rerank) and d.kind == "sparse":
            fail("VECTOR-KIND", "RERANK takes a dense vector")
        v = get(e.input)
        if d.kind == "sparse" and d.idf:
            v = score.idf_weighted(c, name, v)
        if isinstance(e, n.Mmr):
            if d.kind == "multi":
                fail("VECTOR-KIND", "MMR takes one vector a point")
            near = self.by_score(rows, score.similarity(name, d, v), d.descending)
            top = near.valid(near.rows.orderBy(*near.order).limit(e.candidates))
            top = top.withColumn("__gain", F.col("__score") if d.descending else -F.col("__score"))
            out = fuse.mmr(top.select("__id", "__score", "__gain", score.column(name).alias("__vector")), "__vector", "__gain", e.diversity, "DOT" if d.kind == "sparse" else d.distance, e.candidates if q.group or q.threshold is not None else (DEFAULT_LIMIT if q.limit is None else q.limit) + (q.offset or 0))
            full = rows.join(fuse.small(out.select("__id", "__score", F.col("__rank").alias("__order")), e.candidates), "__id")
            return Ranked(full, [F.col("__order"), F.col("__id")], d.descending)
        return self.by_score(rows, score.similarity(name, d, v), d.descending)

    def recommend(self, c: Collection, rows: DataFrame, e: n.Recommend, name: str, d: Any, at: Any) -> Ranked:
        if d.kind == "sparse":
            fail("VECTOR-KIND", "RECOMMEND takes a dense vector")
        where = at or (c, name)
        positive, negative = resolve.stored(*where, e.positive), resolve.stored(*where, e.negative)
        if not positive:
            fail("POINT", "no positive point has a vector")
        if at is None:
            rows = rows.where(c.id_not_in((*e.positive, *e.negative)))
        if e.strategy == "best_score":
            return self.by_score(rows, score.best_score(name, d, positive, negative))
        if e.strategy == "sum_scores":
            return self.by_score(rows, score.sum_scores(name, d, positive, negative))
        if d.kind == "multi":
            fail("VECTOR-KIND", "average_vector takes one vector a point")
        return self.by_score(rows, score.similarity(name, d, score.average(positive, negative)), d.descending)

    def hybrid(self, q: n.Query, c: Collection) -> Ranked:
        """Dense and sparse candidates with the outer WHERE, PARAMS and SCORE THRESHOLD, then fusion."""
        e: n.Hybrid = q.expr
        limit = HYBRID_UNLIMITED if q.limit is None else q.limit * HYBRID_FACTOR
        sources = []
        for name, kind in ((resolve.only(c, e.dense, "dense"), "dense"), (resolve.only(c, e.sparse, "sparse"), "sparse")):
            side = n.Query(n.Nearest(e.text), c.name, n.Target(name, kind), where=q.where, shard=q.shard, threshold=q.threshold)
            r = self.ranked(side, c)
            sources.append((self.page(r, limit, None).select("__id", "__score"), r.descending))
        return self.fused(sources, e.method, dict(q.params), self.base(c, q.where, q.shard), 2 * limit)

    def fused(self, sources: list[tuple[DataFrame, bool]], method: str, params: dict, rows: DataFrame, bound: int) -> Ranked:
        candidates = fuse.union(sources)
        if method == "rrf":
            scores = fuse.rrf(candidates, params.get("rrf_k", RRF_K), params.get("rrf_weights", (1.0,) * len(sources)))
        else:
            scores = fuse.dbsf(candidates)
        return self.by_score(rows.join(fuse.small(scores, bound), "__id"), F.col("__score"))

    # --- groups

    def grouped(self, q: n.Query, c: Collection, r: Ranked) -> DataFrame:
        scope = c.scope()
        found = scope.find(q.group.field) if isinstance(scope, TypedScope) else None
        if isinstance(scope, TypedScope):
            if found is None:
                fail("GROUP", f"{c.name} has no field {q.group.field}")
            key, many = found[0], found[1].typeName() == "array"
        else:
            one, several = scope.text(q.group.field), F.try_variant_get(F.col(PAYLOAD), f"$.{q.group.field}", "array<string>")
            key, many = F.coalesce(several, F.array(one)), True
        limit = GROUP_LIMIT if q.limit is None else q.limit
        rows = fuse.group_hits(r, key, many, q.group.size or GROUP_SIZE, limit, q.offset or 0)
        extra = [F.col("__group").alias("group_id"), F.col("__group_rank").alias("group_rank"), F.col("__rank").alias("rank")]
        if q.group.lookup:
            other = self.catalog.get(q.group.lookup)
            side = other.rows.select(F.col("__id").alias("__other"), F.struct(other.id_output().alias("id"), *(F.col(f"`{p}`") for p in (other.payload or [])), *([F.col(PAYLOAD).alias("payload")] if not other.typed else [])).alias("__lookup"))
            match = F.col("__group") == (F.col("__other") if other.typed else F.coalesce(F.col("__other.num").cast("string"), F.col("__other.str")))
            rows = rows.join(side, match, "left")
            extra.append(F.col("__lookup").alias("lookup"))
        out = self.project(c, rows, q.payload, q.vectors, r.scored, extra)
        return out.orderBy("group_rank", "rank")

    # --- cross encoders

    def cross_rerank(self, q: n.Query) -> DataFrame:
        e: n.CrossRerank = q.expr
        if not e.text:
            fail("PLAN-CROSS-RERANK-QUERY", "the query text is empty")
        if not e.model:
            fail("PLAN-CROSS-RERANK-MODEL", "the model is empty")
        parts = []
        for i, p in enumerate(q.prefetch):
            s = self.source(q, p)
            c = self.catalog.get(s.collection or q.collection)
            r = self.ranked(s, c)
            rows = self.page(r, s.limit, s.offset)
            # ids as text, so that collections with other kinds of ids go together
            text = c.scope().text(e.field)
            parts.append(rows.select(F.lit(c.name).alias("collection"), c.id_output().cast("string").alias("id"), text.alias("text"), F.lit(i).alias("__source")))
        rows = parts[0]
        for other in parts[1:]:
            rows = rows.unionByName(other)
        rows = rows.groupBy("collection", "id").agg(F.min_by("text", "__source").alias("text")).where("text is not null and trim(text) <> ''")
        embedder, query, model = self.embedder, e.text, e.model

        @F.pandas_udf("double")
        def pair_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(embedder.rerank_pairs(query, batch.tolist(), model), dtype=float)

        out = rows.withColumn("score", pair_score("text")).select("id", "score", "text", "collection")
        if q.threshold is not None:
            out = out.where(F.col("score") >= q.threshold)
        out = out.orderBy(F.col("score").desc(), "collection", "id")
        return (out.offset(q.offset) if q.offset else out).limit(DEFAULT_LIMIT if q.limit is None else q.limit)

    # --- results

    def project(self, c: Collection, rows: DataFrame, payload: n.Selector | None, vectors: n.Selector | None, scored: bool = True, extra: list[Column] | None = None) -> DataFrame:
        """id, score, payload (all unless told otherwise) and vectors (none unless told otherwise)."""
        payload = payload or n.Selector(True)
        vectors = vectors or n.Selector(False)
        out = [c.id_output().alias("id"), *([F.col("__score").alias("score")] if scored else []), *(extra or [])]
        taken = {"id", "score"} if scored else {"id"}
        if c.typed:
            if payload.include:
                keep = [p for p in payload.include if p.split(".")[0].removesuffix("[]") in c.payload]
            else:
                keep = [] if payload.all is False else [p for p in c.payload if p not in payload.exclude]
            scope = c.scope()
            out += [scope.find(p)[0].alias(f"payload_{p}" if p in taken else p) for p in keep if scope.find(p)]
        elif payload.include:
            out += [F.try_variant_get(F.col(PAYLOAD), f"$['{p}']", "variant").alias(f"payload_{p}" if p in taken else p) for p in payload.include]
        elif payload.all is not False:
            drop = payload.exclude
            kept = F.col(PAYLOAD)
            if drop:
                entries = F.from_json(F.to_json(PAYLOAD), "map<string,variant>")
                kept = F.parse_json(F.to_json(F.map_filter(entries, lambda k, _: ~k.isin(*drop))))
            out.append(kept.alias("payload"))
        names = vectors.include or ([k for k in c.vectors] if vectors.all else [])
        for k in names:
            if k not in c.vectors:
                fail("UNKNOWN-VECTOR", f"{c.name} has no vector {k}")
            out.append(score.column(k).alias(k if k not in taken and k not in c.payload else f"vector_{k}"))
        return rows.select(*out)
