"""Fusion of ranked sources, grouping, and diversification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.semantics import BROADCAST_ROWS, DBSF_FLAT, DBSF_SIGMAS


def small(rows: DataFrame, bound: int) -> DataFrame:
    """Rows that are known to be at most `bound`, marked for a broadcast if that is few."""
    return F.broadcast(rows) if bound <= BROADCAST_ROWS else rows


def union(sources: Sequence[tuple[DataFrame, bool]]) -> DataFrame:
    """__id, __score, __source and __down (whether larger is better) of all sources; each is cut by its LIMIT."""
    parts = [df.select("__id", "__score", F.lit(i).alias("__source"), F.lit(down).alias("__down")) for i, (df, down) in enumerate(sources)]
    return reduce(DataFrame.unionByName, parts)


def rrf(candidates: DataFrame, k: int, weights: Sequence[float]) -> DataFrame:
    """Sum of weight / (k + rank) over the sources that hold a point."""
    better = F.when(F.col("__down"), -F.col("__score")).otherwise(F.col("__score"))
    rank = F.row_number().over(Window.partitionBy("__source").orderBy(better, "__id"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("__source") + 1)
    return candidates.withColumn("__part", weight / (F.lit(float(k)) + rank)).groupBy("__id").agg(F.sum("__part").alias("__score"))


def dbsf(candidates: DataFrame) -> DataFrame:
    """Sum of (s - (mean - 3 sigma)) / (6 sigma) over the sources that hold a point."""
    own = Window.partitionBy("__source")
    s = F.when(F.col("__down"), F.col("__score")).otherwise(-F.col("__score"))
    rows = candidates.withColumn("__s", s).withColumn("__mean", F.avg("__s").over(own)).withColumn("__sd", F.stddev_samp("__s").over(own))
    flat = F.col("__sd").isNull() | (F.col("__sd") == 0)
    part = F.when(flat, DBSF_FLAT).otherwise((F.col("__s") - (F.col("__mean") - DBSF_SIGMAS * F.col("__sd"))) / (2 * DBSF_SIGMAS * F.col("__sd")))
    return rows.withColumn("__part", part).groupBy("__id").agg(F.sum("__part").alias("__score"))


def group_hits(r: Any, key: Column, many: bool, size: int, limit: int, offset: int) -> DataFrame:
    """The best `size` rows of each group, for the groups ordered by their best row, `limit` of them behind `offset`;
    with __group, __group_rank and __rank. Rows without the key are in no group; a list's row is in several. The rows are
    dealt by group once; a group is then one row with its hits, `size` at most."""
    keyed = r.rows.withColumn("__group", F.explode(F.array_distinct(key)) if many else key).where("__group is not null")
    ranked = r.valid(keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__group").orderBy(*r.order))).where(F.col("__rank") <= size))
    sorted_by = [c for c in ("__score", "__key", "__order", "__id") if c in ranked.columns]
    hits = F.struct(*(F.col(f"`{c}`") for c in ranked.columns if c != "__group"))
    groups = ranked.groupBy("__group").agg(F.collect_list(hits).alias("__hits"), F.min_by(F.struct(*sorted_by), "__rank").alias("__head"))
    heads = groups.select("__group", "__hits", "__head.*").orderBy(*r.order, "__group").limit(offset + limit)  # a row a group, at most LIMIT + OFFSET
    place = F.row_number().over(Window.orderBy(*r.order, "__group"))
    chosen = heads.withColumn("__group_rank", place - offset).where("__group_rank > 0")
    return chosen.select("__group", "__group_rank", F.inline("__hits"))


def mmr(candidates: DataFrame, vector: str, relevance: str, diversity: float, distance: str, wanted: int) -> DataFrame:
    """The first `wanted` of the candidates (CANDIDATES rows at most, so one task holds them) in greedy order:
    (1 - d) relevance - d max likeness to those taken; `__rank` from 1. Each step compares all with the one taken last, so
    memory is that of the vectors."""
    schema = T.StructType([*candidates.schema.fields, T.StructField("__rank", T.IntegerType())])

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        cells = frame[vector]
        if cells.map(lambda x: isinstance(x, dict) or hasattr(x, "asDict")).any():
            columns = {i: k for k, i in enumerate(sorted({i for x in cells for i in x["indices"]}))}
            out = np.zeros((len(cells), len(columns)))
            for r, x in enumerate(cells):
                out[r, [columns[i] for i in x["indices"]]] = x["values"]
            return out
        out = np.array([np.asarray(c, float) for c in cells])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30) if distance == "COSINE" else out

    def like(x: np.ndarray, one: np.ndarray) -> np.ndarray:
        if distance in ("EUCLID", "MANHATTAN"):
            return -np.linalg.norm(x - one, 2 if distance == "EUCLID" else 1, axis=1)
        return x @ one

    def greedy(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.reset_index(drop=True)
        x, gain = matrix(frame), (1 - diversity) * frame[relevance].to_numpy(float)
        left, nearest, order = np.ones(len(frame), bool), np.full(len(frame), -np.inf), []
        while len(order) < min(wanted, len(frame)):
            value = np.where(left, gain - (diversity * nearest if order else 0.0), -np.inf)
            best = int(np.argmax(value))  # ties: the earlier one, candidates come in the order of rank
            order.append(best)
            left[best] = False
            nearest = np.maximum(nearest, like(x, x[best]))
        out = frame.iloc[order].copy()
        out["__rank"] = np.arange(1, len(out) + 1, dtype=np.int32)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield greedy(pd.concat(parts))

    return candidates.coalesce(1).mapInPandas(run, schema)
