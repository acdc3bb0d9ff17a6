"""A training corpus from raw documents: quality, near duplicates, benchmark passages, source mix, token tables.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; every stage's result is written as
Parquet in the shared folder and read again. All stages but the last return the columns of documents.

Ids name documents; where rows share an id, or have none, `near_duplicates` tells them apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import decontam, jaccard, poisson_mix, quality, sst
from sparkseek.llm.common import drop, unused, written
from sparkseek.llm.queries import byte_bpe_path

#: Near duplicates: shingles of this many words, and the similarity as a fraction.
SHINGLE, SIMILAR = 5, (80, 100)
SEED = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained on the labels of the training folds.

    Null, empty and very long texts are scored like all others; rows with a null id are never trained on; repeated rows get
    equal scores; without labels every document has one score; an empty table gives an empty table. Other columns pass
    through, whatever their names.
    """
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    vectors, net = quality.fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    name = unused(docs, "__quality")
    return quality.score(docs, vectors, net, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Texts without words are near nothing, so all of them stay. A null id counts as larger than any other. Of rows that
    repeat id and text one stays; rows with one id (or with none) and different texts are documents of their own, and only
    these are told apart by their texts. An empty table gives an empty table. Other columns pass through, whatever their
    names; of repeated rows that differ in them only, any one stays.
    """
    groups = written(jaccard.near_duplicates(docs, SHINGLE, *SIMILAR, with_sets=True), "pipeline-groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_name"))
    chosen = groups.where("component is not null").groupBy("component").agg(least.alias("c")).select("c.doc_id", "c.set_name")
    chosen = chosen.unionByName(groups.where("component is null").select("doc_id", "set_name").distinct())
    rows = groups.groupBy("doc_id").agg((F.col("doc_id").isNull() | (F.count(F.lit(1)) > 1)).alias("several"))
    chosen = written(chosen.join(rows, chosen["doc_id"].eqNullSafe(rows["doc_id"])).select(chosen["doc_id"], "set_name", "several"), "pipeline-chosen")
    name, digest, first, of = (unused(docs, f"__{x}") for x in ("set", "digest", "first", "of"))
    plain, several = (chosen.where(c).select(F.col("doc_id").alias(first), F.col("set_name").alias(of)) for c in ("not several", "several"))
    out = docs.join(plain, F.col("doc_id") == F.col(first), "left_semi")
    if chosen.where("several").count() <= jaccard.BROADCAST_CLASSES:  # seldom any: no second shuffle of the texts
        several = F.broadcast(several)
    odd = jaccard.with_set_name(docs.join(several, F.col("doc_id").eqNullSafe(F.col(first)), "left_semi"), SHINGLE, name)
    odd = odd.join(several, F.col("doc_id").eqNullSafe(F.col(first)) & (F.col(name) == F.col(of)), "left_semi")
    odd = odd.withColumn(digest, F.md5("text")).dropDuplicates(["doc_id", digest])
    return out.unionByName(odd.select(*docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; items with a null id are searched like others; without items all documents stay;
    repeated rows are judged alike; an empty table gives an empty table. Other columns pass through, whatever their names.
    """
    names = unused(docs, "__items"), unused(docs, "__share")
    found = decontam.find_items(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"), names)
    return found.where(F.size(names[0]) == 0).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents, every source with the same expected share, in global random order.

    A null source is a source; rows with one id are drawn alike, rows without an id by their texts; null and empty texts
    are drawn like others; an empty table gives an empty table. Other columns pass through, whatever their names.
    """
    names = tuple(unused(docs, f"__{x}") for x in poisson_mix.NAMES)
    return poisson_mix.replicate(docs, seed=SEED, names=names).select(*docs.columns)


def token_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted-string tables, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; null ids come first; repeated rows are entries of their own; an empty table
    gives no file and no rows. Only doc_id and text are read.
    """
    return sst.read_tables(sst.write_tables(docs, byte_bpe_path()), with_ids=False).drop("ids")


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontaminate", without_benchmark), ("mix", mixed), ("token_tables", token_tables)]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # what it led to is written
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
