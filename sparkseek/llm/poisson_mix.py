"""Mixing sources to target weights by Poisson replication.

Each document of source s is repeated k times, k drawn from a Poisson distribution whose mean is the target repetition
rate of s: rate(s) = epochs * N * w(s) / sum(w) / n(s), over the sources present. The draw inverts the distribution at a
uniform number taken from an MD5 of (seed, document id), so it depends on no partitioning, retry or order. A mean above
PIECE is a sum of independent draws with means of at most PIECE (the Poisson law is additive), so exp(-mean) never
underflows. The copies are then put in a global random order: range-partitioned and sorted by a hash of
(seed, id, copy).

Everything is DataFrame operations. The only gathered data are one row per source; they are broadcast only if there are
at most BROADCAST_SOURCES of them, and joined by a shuffle otherwise.

Edge cases: a null source is a source of its own; a null id draws as the text 'null'; rows with equal ids draw equal
counts; weights of 0 drop a source; an empty table gives an empty table. Other columns are carried along; one that is
named like a result column (`names`) is replaced by it, and names that start with `__mix_` are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 500.0
BROADCAST_SOURCES = 10_000
SEED = 17
NAMES = ("rate", "n_copies", "copy", "shuffle_key")


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number inside (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def _inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose Poisson(mean) distribution function reaches u; the sequence covers all but 1e-16 of it."""
    most = (mean + 12 * F.sqrt(mean) + 24).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.when(F.exp(-mean) < u, 1).otherwise(0).alias("k"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        c = s["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), (s["k"] + F.when(c < u, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["k"])


def rates(docs: DataFrame, source_col: str, weights: dict[str, float], default_weight: float, epochs: float) -> DataFrame:
    """One row for each source: its rows, and its mean repetition rate."""
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        if w < 0:
            raise ValueError("weights are not negative")
        weight = F.when(F.col("__mix_source") == name, F.lit(float(w))).otherwise(weight)
    counts = docs.groupBy(F.col(source_col).alias("__mix_source")).agg(F.count(F.lit(1)).alias("__mix_n")).withColumn("__mix_w", weight)
    total = counts.agg(F.sum("__mix_n").alias("__mix_all"), F.sum("__mix_w").alias("__mix_ws"))
    rate = F.lit(float(epochs)) * F.col("__mix_all") * F.col("__mix_w") / F.col("__mix_ws") / F.col("__mix_n")
    return counts.join(F.broadcast(total)).select("__mix_source", rate.alias("__mix_rate"))  # total is one row


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0, seed: int = SEED, shuffle: bool = True, names: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """The copies in global random order: the columns of docs, then the result columns: rate, n_copies, copy (from 1)
    and shuffle_key, unless named otherwise."""
    from sparkseek.llm.common import written

    by_source = written(rates(docs, source_col, weights or {}, default_weight, epochs), "mix-rates")
    few = by_source.count() <= BROADCAST_SOURCES
    rows = docs.join(F.broadcast(by_source) if few else by_source, F.col(source_col).eqNullSafe(F.col("__mix_source")))
    digest = F.md5(F.coalesce(F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c, t in docs.dtypes if t == "string")), F.lit("")))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null|"), digest))  # rows without an id draw for themselves
    pieces = F.ceil(F.col("__mix_rate") / PIECE).cast("int")
    draw = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(pieces, F.lit(1))), lambda i: _inverse(_uniform(F.lit(str(seed)), key, i.cast("string")), F.col("__mix_rate") / F.greatest(pieces, F.lit(1)))), F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("__mix_k", F.when(F.col("__mix_rate") > 0, draw).otherwise(0)).where("__mix_k > 0")
    copies = rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_k"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), key, F.col("__mix_copy").cast("string"))), 1, 15), 16, 10).cast("long")
    copies = copies.withColumn("__mix_key", order)
    if shuffle:
        # the key is uniform on 60 bits, so its range is cut evenly; a range partitioning would draw everything twice
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cut = F.floor(F.col("__mix_key") / F.lit(float(1 << 60)) * n).cast("int")
        copies = copies.repartitionById(n, F.least(cut, F.lit(n - 1))).sortWithinPartitions("__mix_key")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return copies.select(*own, *(F.col(c).alias(name) for c, name in zip(("__mix_rate", "__mix_k", "__mix_copy", "__mix_key"), names)))
