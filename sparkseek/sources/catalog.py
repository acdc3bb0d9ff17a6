"""Collections and where their rows are.

A collection is either typed (its payload is ordinary columns of a table) or schemaless (one VARIANT column). Inside the
engine its rows are a frame with `__id`, the payload columns and a column `__v_<name>` for each vector. Changed
collections are written as Parquet, in bucket directories by a hash of the id; a manifest names each bucket's directory,
so a change that names its ids rewrites only their buckets, a reader never sees half a change, and a path that is being
read is never overwritten. The number of buckets follows the collection's bytes.

Under an Engine's own path every collection has one description file (schema, vectors, configuration, manifest, the last
batch of each stream), replaced by a rename; a catalog at the same path reads them all, so nothing is lost with the driver.
One writer at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.errors import fail
from sparkseek.functions.fields import Scope, TypedScope, VariantScope
from sparkseek.functions.text import sparse_column
from sparkseek.functions.vectors import higher_is_better
from sparkseek.nodes import PointId, Sparse
from sparkseek.semantics import BUCKET_BYTES, LEAST_BUCKETS
from sparkseek.sources.files import Files

PAYLOAD = "__payload"
ID_TYPE = T.StructType([T.StructField("s", T.BooleanType()), T.StructField("num", T.DecimalType(20, 0)), T.StructField("str", T.StringType())])
VECTOR_TYPES = {
    "dense": T.ArrayType(T.FloatType()),
    "multi": T.ArrayType(T.ArrayType(T.FloatType())),
    "sparse": T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))]),
}


@dataclass(frozen=True)
class VectorDef:
    """A vector of a collection. `column` names the source column of a registered table. With an `encoding` it is a text
    column: queries by text count their own words in it, and the first change stores the encoded vectors."""

    kind: str = "dense"  # dense sparse multi
    size: int | None = None
    distance: str = "COSINE"
    idf: bool = False
    column: str | None = None
    config: tuple = ()
    encoding: str | None = None  # bm25 or query: the column is a text, encoded when its vectors are needed

    @property
    def descending(self) -> bool:
        return self.kind == "sparse" or higher_is_better(self.distance)


@dataclass
class Collection:
    name: str
    vectors: dict[str, VectorDef]
    rows: DataFrame | None = None  # a frame: __id, payload, __v_*
    typed: bool = True
    shard_column: str | None = None
    config: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    shard_keys: dict[str, dict] = field(default_factory=dict)
    path: str | None = None
    buckets: int = LEAST_BUCKETS
    manifest: dict[int, str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)  # bytes of each bucket
    batches: dict[str, int] = field(default_factory=dict)  # the last batch of each stream
    counts: dict[tuple, dict] = field(default_factory=dict)  # points that hold a term, of the rows as they are

    @property
    def schema(self) -> T.StructType:
        return self.rows.schema

    @property
    def payload(self) -> list[str]:
        return [c for c in self.rows.columns if not c.startswith("__")]

    def id_literal(self, value: PointId) -> Column:
        kind = self.schema["__id"].dataType
        if isinstance(kind, T.StructType):
            number = isinstance(value, int)
            return F.struct(F.lit(not number).alias("s"), F.lit(Decimal(value) if number else None).cast("decimal(20,0)").alias("num"), F.lit(None if number else value).cast("string").alias("str"))
        if isinstance(kind, T.StringType) != isinstance(value, str) or isinstance(value, int) and value >= 1 << 63:
            return F.lit(None).cast(kind)
        return F.lit(value).cast(kind)

    def id_value(self, value: PointId) -> Any:
        return id_value(self.schema["__id"].dataType, value)

    def id_in(self, ids: tuple[PointId, ...]) -> Column:
        """Null for a null id, so that the scan can take it; `id_not_in` keeps those rows."""
        return F.col("__id").isin(*map(self.id_literal, ids))

    def id_not_in(self, ids: tuple[PointId, ...]) -> Column:
        return ~F.coalesce(self.id_in(ids), F.lit(False))

    def id_output(self) -> Column:
        kind = self.schema["__id"].dataType
        return F.coalesce(F.col("__id.num").cast("string"), F.col("__id.str")) if isinstance(kind, T.StructType) else F.col("__id")

    def scope(self) -> Scope:
        vectors = {k: F.col(f"`__v_{k}`") for k in self.vectors}
        if not self.typed:
            return VariantScope(F.col(PAYLOAD), ids=self.id_in, vectors=vectors)
        return TypedScope(T.StructType([f for f in self.schema if not f.name.startswith("__")]), ids=self.id_in, vectors=vectors)


def id_value(kind: T.DataType, value: PointId) -> Any:
    """The id as a value of a column __id of that type, or None if the collection can't have it."""
    number = isinstance(value, int)
    if isinstance(kind, T.StructType):
        return (not number, Decimal(value) if number else None, None if number else value)
    if isinstance(kind, T.StringType) == number or number and value >= 1 << (31 if isinstance(kind, T.IntegerType) else 63):
        return None
    return value


def frame_of(df: DataFrame, id_column: str, vectors: dict[str, VectorDef], payload: list[str] | None = None, shard: str | None = None) -> DataFrame:
    own = {v.column or k for k, v in vectors.items() if v.encoding is None}
    source = lambda k, v: F.col(f"`{v.column or k}`")
    kept = payload if payload is not None else [c for c in df.columns if c not in own and c != id_column]
    return df.select(
        F.col(f"`{id_column}`").alias("__id"), *(F.col(f"`{c}`") for c in kept),
        *((sparse_column(source(k, v), v.encoding) if v.encoding else source(k, v)).alias(f"__v_{k}") for k, v in vectors.items()),
        *(source(k, v).alias(f"__t_{k}") for k, v in vectors.items() if v.encoding),
        *([F.col(f"`{shard}`").cast("string").alias("__shard")] if shard else []),
    )


def _source_bytes(rows: DataFrame) -> int:
    """The bytes of the files that rows come from, as far as the plan knows them."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)  # what isn't known is the largest number


DESCRIPTION = "collection.json"
MOST_BUCKETS = 1 << 17  # directories of one collection


class Catalog:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self._path = spark, None if path is None else path.rstrip("/")
        self.durable = path is not None
        self.collections: dict[str, Collection] = {}
        if self.durable:
            self._load()

    @property
    def path(self) -> str:
        """Where changed collections are stored: the given path, or a folder of the warehouse, which all executors see."""
        if self._path is None:
            self._path = f"{self.spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/collections-{uuid.uuid4().hex}"
        return self._path

    def get(self, name: str) -> Collection:
        if name not in self.collections:
            fail("COLLECTION", f"there is no collection {name}")
        return self.collections[name]

    def empty(self, name: str, vectors: dict[str, VectorDef]) -> Collection:
        """A new schemaless collection."""
        schema = T.StructType([T.StructField("__id", ID_TYPE), T.StructField(PAYLOAD, T.VariantType()), T.StructField("__shard", T.StringType())] + [T.StructField(f"__v_{k}", VECTOR_TYPES[v.kind]) for k, v in vectors.items()])
        out = Collection(name, vectors, self.spark.createDataFrame([], schema), typed=False, shard_column="__shard")
        self.collections[name] = out
        return out

    # --- descriptions

    def save(self, c: Collection) -> None:
        """Replaces the collection's description, if the catalog outlives its engine and the collection is its own."""
        if not self.durable or c.typed and c.path is None:
            return
        kept = {k: getattr(c, k) for k in ("name", "typed", "shard_column", "config", "indexes", "shard_keys", "path", "buckets", "manifest", "sizes", "batches")}
        kept |= {"vectors": {k: asdict(v) for k, v in c.vectors.items()}, "schema": c.schema.jsonValue()}
        Files(self.spark).replace(f"{self.path}/{c.name}/{DESCRIPTION}", json.dumps(kept))

    def drop(self, name: str) -> None:
        self.get(name)
        del self.collections[name]
        if self.durable:
            Files(self.spark).remove(f"{self.path}/{name}")

    def _load(self) -> None:
        files = Files(self.spark)
        for folder in files.children(self._path):
            text = files.read(f"{folder}/{DESCRIPTION}")
            if text is None:
                continue
            d = json.loads(text)
            vectors = {k: VectorDef(**v | {"config": tuple((a, b) for a, b in v["config"])}) for k, v in d["vectors"].items()}
            c = Collection(d["name"], vectors, typed=d["typed"], shard_column=d["shard_column"], config=d["config"], indexes=d["indexes"], shard_keys=d["shard_keys"], path=d["path"], buckets=d["buckets"], batches=d["batches"])
            c.manifest, c.sizes = {int(k): v for k, v in d["manifest"].items()}, {int(k): v for k, v in d["sizes"].items()}
            self.reload(c, T.StructType.fromJson(d["schema"]))
            self.collections[c.name] = c

    # --- changes

    @staticmethod
    def bucket(c: Collection) -> Column:
        return F.pmod(F.xxhash64("__id"), F.lit(c.buckets)).cast("int")

    def buckets_of(self, c: Collection, ids: DataFrame) -> list[int]:
        """The buckets of the column __id, by the hash that stores them: a row a bucket."""
        return sorted(r[0] for r in ids.select(self.bucket(c).alias("b")).distinct().collect())

    def ids(self, c: Collection, ids: tuple[PointId, ...]) -> DataFrame:
        """Ids as a frame with the column __id; those that can't be the collection's are left out."""
        return self.spark.createDataFrame([(v,) for v in dict.fromkeys(map(c.id_value, ids)) if v is not None], T.StructType([T.StructField("__id", c.schema["__id"].dataType)]))

    def store(self, c: Collection, rows: DataFrame, buckets: list[int] | None = None, batch: tuple[str, int] | None = None) -> None:
        """Writes the rows of the buckets (of all, if None) and makes them the collection's."""
        if c.path is None:
            if buckets is not None:  # not stored yet: everything is written
                fail("EXECUTION", "a collection is stored whole before it is changed in part")
            c.path = f"{self.path}/{c.name}"
            c.vectors = {k: replace(v, column=None, encoding=None) for k, v in c.vectors.items()}
        rows = rows.drop(*(x for x in rows.columns if x.startswith("__t_")))
        schema = rows.schema
        if buckets is not None and sum(c.sizes.values()) > 4 * c.buckets * BUCKET_BYTES:  # grown: dealt anew, whole
            rest = [b for b in c.manifest if b not in set(buckets)]
            rows, buckets = rows.unionByName(self.part(c, rest)) if rest else rows, None
        if buckets is None:
            known = sum(c.sizes.values()) or _source_bytes(rows)
            c.buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, known // BUCKET_BYTES))
        version = f"{c.path}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self.bucket(c))
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), len(buckets) if buckets is not None else c.buckets)
        dealt.repartition(n, "__bucket").sortWithinPartitions("__bucket", "__id").write.partitionBy("__bucket").parquet(version)
        written = Files(self.spark).sizes(version)
        for b in list(c.manifest) if buckets is None else buckets:
            c.manifest.pop(b, None)
            c.sizes.pop(b, None)
        for folder, size in written.items():
            if folder.startswith("__bucket="):
                b = int(folder.removeprefix("__bucket="))
                c.manifest[b], c.sizes[b] = f"{version}/{folder}", size
        if batch is not None:
            c.batches[batch[0]] = batch[1]
        c.counts.clear()
        self.reload(c, schema)
        self.save(c)

    def reload(self, c: Collection, schema: T.StructType) -> None:
        paths = [c.manifest[b] for b in sorted(c.manifest)]
        c.rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def part(self, c: Collection, buckets: list[int]) -> DataFrame:
        """The stored rows of the buckets."""
        paths = [c.manifest[b] for b in buckets if b in c.manifest]
        return self.spark.read.schema(c.schema).parquet(*paths) if paths else self.spark.createDataFrame([], c.schema)

    def vacuum(self, name: str) -> int:
        """Removes the versions of a stored collection that its manifest no longer names, once no query reads them; how
        many."""
        c = self.get(name)
        if c.path is None:
            return 0
        files, used = Files(self.spark), {v.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in c.manifest.values()}
        old = [f for f in files.children(c.path) if f.rsplit("/", 1)[1] not in used | {DESCRIPTION}]
        for f in old:
            files.remove(f)
        return len(old)


def vector_value(kind: str, value: Any) -> Any:
    """A vector literal as a value of its column, or None if it is of another kind."""
    if isinstance(value, Sparse):
        pairs = sorted(zip(value.indices, value.values))
        return {"indices": [i for i, _ in pairs], "values": [v for _, v in pairs]} if kind == "sparse" else None
    nested = bool(value) and isinstance(value[0], (tuple, list))
    if kind == "multi":
        return [list(r) for r in value] if nested else [list(value)]
    return list(value) if kind == "dense" and not nested else None
