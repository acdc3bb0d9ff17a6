"""The engine: registers tables as collections and runs statements.

    engine = Engine(spark)
    engine.register("embeddings", df, id="vec_id", vectors={"embedding": VectorDef(size=64)})
    engine.query("QUERY POINT 7 FROM embeddings USING embedding WHERE label = 3 LIMIT 10")   # a DataFrame

Queries are lazy, but for those with PARAMS (timeout = seconds): these run at once, under the limit. Statements that change
something take effect before the next one of a script is looked at. With a path of its own an engine keeps its collections
there, and the next engine at that path has them.
"""

from __future__ import annotations

import dataclasses
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek import nodes as n
from sparkseek.embed import Embedder, HashingEmbedder
from sparkseek.errors import SeekError, fail
from sparkseek.inject import inject_filter
from sparkseek.operators import points
from sparkseek.parser import parse, parse_one
from sparkseek.plans.query import SEED, Planner
from sparkseek.routes import compiled
from sparkseek.semantics import DENSE, DENSE_SIZE, MULTI, MULTI_SIZE, SPARSE
from sparkseek.sources.catalog import Catalog, Collection, VectorDef, frame_of

QUERIES = (n.Query, n.Scroll, n.Count, n.ShowCollections, n.ShowCollection, n.ShowShardKeys)


@dataclass
class Result:
    statement: str
    ok: bool
    data: DataFrame | None = None
    error: SeekError | None = None
    seconds: float = 0.0


@dataclass
class Report:
    results: list[Result] = field(default_factory=list)

    @property
    def succeeded(self) -> int:
        return sum(r.ok for r in self.results)

    @property
    def failed(self) -> int:
        return len(self.results) - self.succeeded

    @property
    def ok(self) -> bool:
        return not self.failed


class Engine:
    def __init__(self, spark: SparkSession, embedder: Embedder | None = None, path: str | None = None, seed: int = SEED):
        self.spark, self.embedder = spark, embedder or HashingEmbedder()
        self.catalog = Catalog(spark, path)
        self.planner = Planner(self.catalog, self.embedder, seed)

    # --- collections

    def register(self, name: str, df: DataFrame, id: str, vectors: dict[str, VectorDef] | None = None, payload: list[str] | None = None, shard: str | None = None) -> Collection:
        """A table as a collection. Columns other than the id's and the vectors' are payload, or those listed."""
        vectors = vectors or {}
        out = Collection(name, vectors, frame_of(df, id, vectors, payload, shard), shard_column=shard)
        self.catalog.collections[name] = out
        return out

    def collection(self, name: str) -> Collection:
        return self.catalog.get(name)

    # --- statements

    def query(self, statement: Any) -> DataFrame:
        """The rows of one statement that reads."""
        s = parse_one(statement) if isinstance(statement, str) else statement
        if not isinstance(s, QUERIES):
            fail("EXECUTION", "the statement returns no rows; use execute")
        return self.timed(s)

    def page(self, statement: Any) -> tuple[DataFrame, Any]:
        """The rows of a SCROLL, and the id that AFTER of the next page takes: None behind the last page, and for a
        collection without rows."""
        s = parse_one(statement) if isinstance(statement, str) else statement
        if not isinstance(s, n.Scroll):
            fail("EXECUTION", "only SCROLL has pages")
        return self.timed(s), points.next_cursor(self.planner, s)

    def execute(self, script: Any, on_error: str = "stop") -> Report:
        """Runs a script's statements in order; `on_error` is stop or continue. Syntax is checked before any runs."""
        if on_error not in ("stop", "continue"):
            fail("EXECUTION", "on_error is stop or continue")
        statements = parse(script) if isinstance(script, str) else [script] if dataclasses.is_dataclass(script) else list(script)
        report = Report()
        for s in statements:
            began = time.monotonic()
            try:
                data = self.timed(s)
                report.results.append(Result(type(s).__name__, True, data, seconds=time.monotonic() - began))
            except (SeekError, PySparkException, Py4JJavaError) as e:
                if not isinstance(e, SeekError):  # what Spark says in many lines
                    e = SeekError("EXECUTION", str(e).strip().split("\n")[0])
                report.results.append(Result(type(s).__name__, False, error=e, seconds=time.monotonic() - began))
                if on_error == "stop":
                    break
        return report

    def execute_async(self, script: Any, on_error: str = "stop") -> Future[Report]:
        """`execute` on a thread of its own."""
        return self.background(lambda: self.execute(script, on_error))

    @staticmethod
    def background(work: Callable[[], Any]) -> Future:
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(work)
        finally:
            pool.shutdown(wait=False)

    @staticmethod
    def reads(s: Any) -> bool:
        return isinstance(s, QUERIES)

    def run(self, s: Any) -> DataFrame | None:
        if isinstance(s, n.Query):
            return self.planner.query(s)
        if isinstance(s, n.Scroll):
            return points.scroll(self.planner, s)
        if isinstance(s, n.Count):
            return points.count(self.planner, s)
        if isinstance(s, n.Upsert):
            points.upsert(self.catalog, self.embedder, s)
        elif isinstance(s, (n.Delete, n.ClearPayload, n.DeletePayload, n.DeleteVector, n.UpdatePayload, n.UpdateVector)):
            points.change(self.catalog, s)
        else:
            return self.define(s)
        return None

    def timed(self, s: Any) -> DataFrame | None:
        """`run`; with PARAMS (timeout = seconds) everything that Spark does for it is cancelled then, so the rows (LIMIT
        at most) are fetched before the answer."""
        seconds = dict(getattr(s, "params", None) or ()).get("timeout")
        if seconds is None:
            return self.run(s)
        tag = f"timeout-{uuid.uuid4().hex}"
        over = threading.Event()

        def stop() -> None:
            over.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(seconds, stop)
        self.spark.addTag(tag)
        timer.start()
        try:
            df = self.run(s)
            return None if df is None else self.spark.createDataFrame(df.collect(), df.schema)
        except Exception as e:
            if over.is_set():
                raise SeekError("EXECUTION", f"the statement took more than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            self.spark.removeTag(tag)

    def collect(self, statement: str) -> list:
        """The rows of a query."""
        return self.query(statement).collect()

    # --- definitions

    def define(self, s: Any) -> DataFrame | None:
        collections = self.catalog.collections
        if isinstance(s, n.CreateCollection):
            if s.name in collections:
                fail("COLLECTION", f"{s.name} is there already")
            c = self.catalog.empty(s.name, self._vectors(s))
            c.config = {k: dict(v) for k, v in s.config}
            if s.model:
                c.config["MODEL"] = {"dense": s.model}
            for key in c.config.get("PARAMS", {}).get("shard_keys", ()):
                c.shard_keys[key] = {}
            self.catalog.save(c)
        elif isinstance(s, n.AlterCollection):
            for k, v in s.config:
                self.catalog.get(s.name).config.setdefault(k, {}).update(dict(v))
            self.catalog.save(self.catalog.get(s.name))
        elif isinstance(s, n.DropCollection):
            self.catalog.drop(s.name)
        elif isinstance(s, n.CreateIndex):
            self.catalog.get(s.collection).indexes[s.field] = {"type": s.type} | dict(s.options)
            self.catalog.save(self.catalog.get(s.collection))
        elif isinstance(s, n.DropIndex):
            if self.catalog.get(s.collection).indexes.pop(s.field, None) is None:
                fail("INDEX", f"{s.field} has no index")
            self.catalog.save(self.catalog.get(s.collection))
        elif isinstance(s, n.CreateShardKey):
            if s.key in self.catalog.get(s.collection).shard_keys:
                fail("SHARD", f"{s.key} is there already")
            self.catalog.get(s.collection).shard_keys[s.key] = dict(s.options)
            self.catalog.save(self.catalog.get(s.collection))
        elif isinstance(s, n.DropShardKey):
            c = self.catalog.get(s.collection)
            if c.shard_keys.pop(s.key, None) is None:
                fail("SHARD", f"there is no shard key {s.key}")
            if c.rows is not None and "__shard" in c.rows.columns:
                self.catalog.store(c, c.rows.where(~F.col("__shard").eqNullSafe(F.lit(s.key))))
            self.catalog.save(c)
        elif isinstance(s, n.ShowCollections):
            return self.spark.createDataFrame([(k,) for k in sorted(collections)], "name string")
        elif isinstance(s, n.ShowCollection):
            c = self.catalog.get(s.name)
            rows = [("vector", k, f"{d.kind}({d.size}, {d.distance})" if d.kind != "sparse" else f"sparse(idf={d.idf})".lower()) for k, d in c.vectors.items()]
            rows += [("payload", k, c.schema[k].dataType.simpleString()) for k in c.payload] + [("index", k, str(v.get("type"))) for k, v in c.indexes.items()]
            rows += [("config", f"{k}.{a}", str(b)) for k, v in c.config.items() for a, b in v.items()]
            return self.spark.createDataFrame(rows, "part string, name string, value string")
        elif isinstance(s, n.ShowShardKeys):
            c = self.catalog.get(s.collection)
            return self.spark.createDataFrame([(k,) for k in sorted(c.shard_keys)], "shard_key string")
        else:
            fail("PARSE-STATEMENT", f"unknown statement {type(s).__name__}")
        return None

    @staticmethod
    def _vectors(s: n.CreateCollection) -> dict[str, VectorDef]:
        out: dict[str, VectorDef] = {}
        for v in s.vectors:
            idf = v.kind == "sparse" and dict(dict(v.config).get("SPARSE", dict(v.config).get("INDEX", ()))).get("modifier", "idf").lower() == "idf"
            out[v.name] = VectorDef(v.kind, v.size, v.distance or "DOT", idf, config=v.config)
        if s.mode != "plain" and not out:
            out[s.dense or DENSE] = VectorDef("dense", DENSE_SIZE)
            if s.mode != "dense":
                out[s.sparse or SPARSE] = VectorDef("sparse", idf=True, distance="DOT")
            if s.mode == "hybrid_rerank":
                out[MULTI] = VectorDef("multi", MULTI_SIZE)
        return out or {DENSE: VectorDef("dense", None)}

    # --- looking without running

    def plan_text(self, s: Any, mode: str = "formatted") -> str:
        """Spark's plan of a statement that reads."""
        df = self.run(s)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def explain(self, source: str, mode: str = "formatted") -> str:
        """What each statement is, and for those that read, Spark's plan."""
        out = []
        for s in parse(source):
            lines = [f"statement: {type(s).__name__}"]
            if isinstance(s, n.Query):
                lines += [f"expression: {type(s.expr).__name__}", f"collection: {s.collection}", f"common tables: {len(s.ctes)}", f"sources: {len(s.prefetch)}", f"filter: {'yes' if s.where is not None else 'no'}", f"limit: {s.limit}"]
            if isinstance(s, QUERIES):
                lines.append(self.plan_text(s, mode))
            out.append("\n".join(lines))
        return "\n\n".join(out)

    @staticmethod
    def compile(source: str) -> list[dict]:
        """For each statement its type, the request of a vector store's REST interface that it stands for, and its tree."""
        return [compiled(s) for s in parse(source)]

    inject_filter = staticmethod(inject_filter)
