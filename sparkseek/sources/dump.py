"""A collection as a script: CREATE COLLECTION, CREATE INDEX and UPSERTs in batches.

`dump` writes it to one file of the driver, to a temporary name that is then renamed; rows stream through the driver one
partition at a time. `dump_folder` writes it to a folder that all executors see: `points` has one UPSERT a line, written
by the executors, and `definitions`, which comes last, one other statement a line. `restore` runs such a folder: the
definitions on the driver, the UPSERTs on the executors, so no side of it grows with the collection but their files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkseek import nodes as n
from sparkseek.errors import fail
from sparkseek.operators.points import embedded, plain
from sparkseek.parser import parse_one
from sparkseek.sources.catalog import PAYLOAD, Collection, id_value
from sparkseek.sources.files import Files

if TYPE_CHECKING:
    from sparkseek.engine import Engine


def quoted(text: str) -> str:
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(raw, escaped)
    return f"'{text}'"


def literal(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        text = repr(v)
        return text if "." in text or "e" in text else f"{text}.0"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{quoted(k)}: {literal(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return quoted(str(v))


def create_text(c: Collection) -> str:
    parts = []
    for name, d in c.vectors.items():
        if d.kind == "sparse":
            parts.append(f"{quoted(name)} SPARSE WITH SPARSE (modifier = '{'idf' if d.idf else 'none'}')")
        else:
            multi = " WITH MULTIVECTOR (comparator = 'max_sim')" if d.kind == "multi" else ""
            parts.append(f"{quoted(name)} VECTOR({d.size or 1}, {d.distance}){multi}")
    blocks = "".join(f" WITH {k} ({', '.join(f'{a} = {literal(b)}' for a, b in v.items())})" for k, v in c.config.items() if k != "MODEL" and v)
    return f"CREATE COLLECTION {quoted(c.name)} ({', '.join(parts)}){blocks};"


def index_text(c: Collection) -> Iterator[str]:
    for field, options in c.indexes.items():
        kind = f" TYPE {options['type']}" if options.get("type") else ""
        rest = {k: v for k, v in options.items() if k != "type"}
        yield f"CREATE INDEX ON COLLECTION {quoted(c.name)} FOR {quoted(field)}{kind}" + (f" WITH ({', '.join(f'{k} = {literal(v)}' for k, v in rest.items())})" if rest else "") + ";"


def _number(v: Any) -> Any:
    return [_number(x) for x in v] if isinstance(v, (list, tuple)) else float(v)


def point_text(row: Any, c: Collection) -> str:
    payload = json.loads(row["payload"] or "{}")
    vectors = {}
    for name, d in c.vectors.items():
        v = row[f"v_{name}"]
        if v is not None:
            vectors[name] = {"indices": list(v["indices"]), "values": _number(v["values"])} if d.kind == "sparse" else _number(v)
    entries = {"id": int(row["id"]) if row["number"] else row["id"]} | ({"vector": vectors} if vectors else {}) | payload
    return literal(entries)


def _points(c: Collection) -> DataFrame:
    ids = c.schema["__id"].dataType.typeName()
    number = ~F.col("__id.s") if ids == "struct" else F.lit(ids != "string")
    payload = F.to_json(F.struct(*(F.col(f"`{p}`") for p in c.payload))) if c.typed and c.payload else F.lit("{}") if c.typed else F.to_json(PAYLOAD)
    return c.rows.select("__id", c.id_output().cast("string").alias("id"), number.alias("number"), payload.alias("payload"), *(F.col(f"`__v_{k}`").alias(f"v_{k}") for k in c.vectors))


def _upserts(rows: Iterable[Any], c: Collection, batch: int, between: str) -> Iterator[str]:
    held: list[str] = []
    for row in rows:
        held.append(point_text(row, c))
        if len(held) == batch:
            yield f"UPSERT INTO {quoted(c.name)} VALUES{between}" + f",{between}".join(held) + ";"
            held = []
    if held:
        yield f"UPSERT INTO {quoted(c.name)} VALUES{between}" + f",{between}".join(held) + ";"


def statements(c: Collection, batch: int = 100) -> Iterator[str]:
    yield create_text(c)
    yield from index_text(c)
    yield from _upserts(_points(c).orderBy("__id").toLocalIterator(), c, batch, "\n  ")


def dump(c: Collection, path: str, batch: int = 100) -> int:
    """Writes the script to a file of the driver; returns the number of statements."""
    count = 0
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        for s in statements(c, batch):
            f.write(s + "\n")
            count += 1
    os.replace(f"{path}.part", path)
    return count


def dump_folder(c: Collection, folder: str, batch: int = 100) -> None:
    """Writes the script to a new folder of a file system that all executors see."""
    plain_c = Collection(c.name, c.vectors)  # without its rows, for the executors

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for i in range(0, b.num_rows, batch) for row in b.slice(i, batch).to_pylist())
        for line in _upserts(rows, plain_c, batch, " "):
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.large_string()).cast(pa.string())], names=["value"])

    _points(c).drop("__id").mapInArrow(write, "value string").write.text(f"{folder}/points")
    Files(c.rows.sparkSession).replace(f"{folder}/definitions", "\n".join([create_text(c), *index_text(c)]))


def restore(engine: Engine, folder: str) -> Collection:
    """Makes the collection of a folder that `dump_folder` wrote. Of points with equal ids the last one counts. Texts of
    points without vectors are embedded as an UPSERT does, by the engine's embedder on the executors."""
    catalog, embedder = engine.catalog, engine.embedder
    definitions = Files(catalog.spark).read(f"{folder}/definitions")
    if definitions is None:
        fail("EXECUTION", f"{folder} holds no whole dump")
    made = [parse_one(line) for line in definitions.split("\n")]
    for s in made:
        engine.run(s)
    c = catalog.get(made[0].name)
    vectors = [f for f in c.schema if f.name.startswith("__v_")]
    kind, plain_c = c.schema["__id"].dataType, Collection(c.name, c.vectors)
    schema = T.StructType([c.schema["__id"], T.StructField("payload", T.StringType()), T.StructField("shard", T.StringType()), *vectors, T.StructField("__file", T.StringType()), T.StructField("__block", T.LongType()), T.StructField("__place", T.LongType())])
    arrow = to_arrow_schema(schema)
    names = arrow.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for b in batches:
            for i in range(b.num_rows):
                line, file, block = (x[0].as_py() for x in b.slice(i, 1).columns)
                u = parse_one(line)
                if not isinstance(u, n.Upsert):
                    fail("EXECUTION", "a folder's points are UPSERTs")
                rows = []
                for p, found in zip(u.points, embedded(plain_c, u, embedder)):
                    v = id_value(kind, p.id)
                    row = (dict(zip(("s", "num", "str"), v)), json.dumps({k: plain(x) for k, x in p.payload}), u.shard, *(found.get(f.name[4:]) for f in vectors), file, block, place)
                    rows.append(dict(zip(names, row)))
                    place += 1
                yield pa.RecordBatch.from_pylist(rows, arrow)

    lines = catalog.spark.read.text(f"{folder}/points").select("value", "_metadata.file_path", "_metadata.file_block_start")
    last = Window.partitionBy("__id").orderBy(F.col("__file").desc(), F.col("__block").desc(), F.col("__place").desc())
    rows = lines.mapInArrow(read, schema).withColumn("__nth", F.row_number().over(last)).where("__nth = 1")
    rows = rows.withColumn(PAYLOAD, F.parse_json("payload")).withColumn("__shard", F.col("shard"))
    catalog.store(c, rows.select(*(F.col(f"`{x}`") for x in c.rows.columns)))
    return c
