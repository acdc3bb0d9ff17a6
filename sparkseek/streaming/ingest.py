"""Structured Streaming into a collection: each micro-batch is merged as an upsert of its rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkseek.engine import Engine


def merge(engine: Engine, name: str, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> None:
    """Rows (the collection's id as `__id`, payload columns, `__v_` vectors) take the place of those with equal ids; of
    equal ids in the batch the last by `order` counts, and of those (or without an order) the one whose values hash
    highest, so a repeated batch does the same. Only the buckets that the batch touches are rewritten. A batch (stream,
    number) that the collection already holds is passed over."""
    catalog = engine.catalog
    c = catalog.get(name)
    if batch is not None and c.batches.get(batch[0], -1) >= batch[1]:
        return
    if c.path is None:
        catalog.store(c, c.rows)
    values = F.xxhash64(*(F.to_json(f"`{f.name}`") if isinstance(f.dataType, T.VariantType) else F.col(f"`{f.name}`") for f in rows.schema))
    last = F.row_number().over(Window.partitionBy("__id").orderBy(*([F.col(order).desc()] if order is not None else []), values.desc()))
    rows = rows.withColumn("__last", last).where("__last = 1").select(*(F.col(f"`{x}`") for x in c.rows.columns))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read three times; what is lost is computed again
    try:
        touched = catalog.buckets_of(c, rows.select("__id"))
        if touched:
            kept = catalog.part(c, touched).join(rows.select("__id"), "__id", "left_anti").select(*(F.col(f"`{x}`") for x in c.rows.columns))
            catalog.store(c, kept.unionByName(rows), touched, batch)
    finally:
        rows.unpersist()


def ingest(engine: Engine, name: str, stream: DataFrame, checkpoint: str, order: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream. The collection's description holds the number of the last batch with the rows it brought, so a
    batch that runs again, also after a restart of the driver, is counted once. That takes an engine with a path of its
    own: the checkpoint outlives the driver, and so must what it says is done."""
    if not engine.catalog.durable:
        raise ValueError("a stream needs an engine with a path, Engine(spark, path=...)")
    engine.catalog.get(name)
    writer = stream.writeStream.foreachBatch(lambda rows, k: merge(engine, name, rows, order, (checkpoint, k))).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
