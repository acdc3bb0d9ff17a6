"""The registered queries: one or more for each operator, and DuckDB SQL that gives the same rows.

Every query runs over its whole tables; LIMIT is part of what is asked. Scores are rounded to six decimals on both sides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.embed import Embedder
from sparkseek.engine import Engine
from sparkseek.errors import SeekError
from sparkseek.functions.text import tokens
from sparkseek.inject import inject_filter
from sparkseek.parser import parse_one
from sparkseek.semantics import BM25_AVERAGE, BM25_B, BM25_K1, DBSF_SIGMAS, EARTH_RADIUS_M, RRF_K
from sparkseek.sources.catalog import VectorDef
from sparkseek.sources.convert import convert_request
from sparkseek.sources.dump import dump_folder, restore
from sparkseek.sources.files import Files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "labels": "doc_id", "benchmark": "item_id", "pages": "page_id"}
TEXT_QUERY = "the thing and of the house"
SPARSE_QUERY = "that with from they"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """All tables as collections. Derived columns give the shapes that the tables lack: multi-vectors, lists, objects and
    places."""
    e = Engine(spark)
    for name, key in IDS.items():
        e.register(name, _read(spark, sf_dir, name), key)
    rows = _read(spark, sf_dir, "embeddings")
    rows = rows.withColumn("parts", F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4))))
    names = {"embedding": "COSINE", "dots": "DOT", "euclid": "EUCLID", "manhattan": "MANHATTAN"}
    vectors = {k: VectorDef(size=64, distance=d, column="embedding") for k, d in names.items()} | {"parts": VectorDef("multi", 16, "DOT")}
    e.register("embeddings", rows, "vec_id", vectors, payload=["label"])
    k = F.col("vec_id")
    place = F.struct(((k * 7919 % 18000) / 100.0 - 90).alias("lat"), ((k * 104729 % 36000) / 100.0 - 180).alias("lon"))
    shaped = _read(spark, sf_dir, "embeddings").select(
        "vec_id", "label", "embedding", place.alias("place"), F.array((k % 5).alias("a"), (k % 7 + 10).alias("b")).alias("tags"),
        F.array(F.struct(F.col("label").alias("label"), (k % 5).alias("rank")), F.struct((F.col("label") + 1).alias("label"), (k % 3).alias("rank"))).alias("items"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(k % 10).alias("maybe"), F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k)).alias("some"),
        (k % 3).cast("string").alias("region"),
    )
    e.register("shaped", shaped, "vec_id", {"embedding": VectorDef(size=64)}, shard="region")
    halves = _read(spark, sf_dir, "embeddings").withColumn("half", F.when(k % 2 == 0, F.col("embedding")))
    e.register("halves", halves, "vec_id", {"embedding": VectorDef(size=64), "half": VectorDef(size=64)}, payload=["label"])
    docs = _read(spark, sf_dir, "documents")
    encoded = {k: VectorDef("sparse", distance="DOT", idf=k == "idf", column="text", encoding="bm25") for k in ("bm25", "idf")}
    e.register("documents", docs, "doc_id", encoded, payload=["lang", "source", "n_chars", "text"])
    line = _read(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    e.register("lineitem", line, "line_id")
    return e


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)) if "score" in df.columns else df


def seek(name: str, statement: str, sql: str | None, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    QUERIES[name] = lambda spark, sf_dir: then(_rounded(engine(spark, sf_dir).query(statement)))
    if sql is not None:
        ORACLE[name] = sql


# --- SQL pieces -----------------------------------------------------------------------------------------------


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})))"


def _far(a: str, b: str, p: int) -> str:
    if p == 2:
        return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)))"


def _v(i: int) -> str:
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {i})"


def _scored(score: str, where: str = "true") -> str:
    """id, label and score of the embeddings; q7, q8, ... in `score` are other rows' vectors."""
    named = sorted({int(x) for x in re.findall(r"\bq(\d+)\b", score)})
    return f"SELECT vec_id AS id, label, {score} AS score FROM embeddings" + "".join(f", (SELECT embedding AS q{i} FROM embeddings WHERE vec_id = {i}) AS t{i}" for i in named) + f" WHERE {where}"


def _top(score: str, where: str = "true", n: int = 10, down: bool = True, offset: int = 0, having: str = "true") -> str:
    return f"SELECT id, label, round(score, 6) AS score FROM ({_scored(score, where)}) WHERE {having} ORDER BY {'' if not down else '-'}score, id LIMIT {n} OFFSET {offset}"


def _ids(score: str, where: str, n: int, down: bool = True) -> str:
    return f"(SELECT id, score, row_number() OVER (ORDER BY {'-' if down else ''}score, id) AS r FROM ({_scored(score, where)}) ORDER BY r LIMIT {n})"


# --- nearest --------------------------------------------------------------------------------------------------

FROM = "FROM embeddings USING embedding"
C7, C42 = _cos("embedding", "q7"), _cos("embedding", "q42")
VECTOR = [round(((i * 37) % 17 - 8) / 10, 1) for i in range(64)]
LITERAL = "[" + ", ".join(map(str, VECTOR)) + "]"

seek("nearest_cosine", f"QUERY VECTOR {LITERAL} {FROM} LIMIT 10", _top(_cos("embedding", f"{LITERAL}::DOUBLE[]")))
seek("nearest_dot", "QUERY POINT 7 FROM embeddings USING dots LIMIT 10", _top(_dot("embedding", "q7"), "vec_id <> 7"))
seek("nearest_euclid", "QUERY POINT 7 FROM embeddings USING euclid LIMIT 10", _top(_far("embedding", "q7", 2), "vec_id <> 7", down=False))
seek("nearest_manhattan", "QUERY POINT 7 FROM embeddings USING manhattan LIMIT 10", _top(_far("embedding", "q7", 1), "vec_id <> 7", down=False))
seek("nearest_by_point", f"QUERY POINT 7 {FROM}", _top(C7, "vec_id <> 7"))
seek("nearest_filtered", f"QUERY POINT 7 {FROM} WHERE label = 3 OR label IN (5, 6) LIMIT 20", _top(C7, "vec_id <> 7 AND label IN (3, 5, 6)", 20))
seek("nearest_threshold", f"QUERY POINT 7 {FROM} SCORE THRESHOLD 0.1 LIMIT 1000", _top(C7, "vec_id <> 7", 1000, having="score >= 0.1"))
seek("nearest_threshold_distance", "QUERY POINT 7 FROM embeddings USING euclid SCORE THRESHOLD 1.3 LIMIT 1000", _top(_far("embedding", "q7", 2), "vec_id <> 7", 1000, down=False, having="score <= 1.3"))
seek("nearest_offset", f"QUERY POINT 7 {FROM} LIMIT 10 OFFSET 15", _top(C7, "vec_id <> 7", offset=15))
seek("nearest_params", f"QUERY POINT 7 {FROM} PARAMS (hnsw_ef = 64, exact = false, quantization = {{rescore: true}}) LIMIT 10", _top(C7, "vec_id <> 7"))
seek("nearest_lookup_from", "WITH a AS (QUERY POINT 7 USING embedding LIMIT 10) QUERY FUSION RRF FROM embeddings PREFETCH (a LOOKUP FROM halves VECTOR embedding) LIMIT 10", f"SELECT id, label, round(1.0 / ({RRF_K} + r), 6) AS score FROM {_ids(C7, 'true', 10)} JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id)")
seek("multi_maxsim", "QUERY POINT 7 FROM embeddings USING parts AS MULTI LIMIT 10", _top(" + ".join(f"greatest({', '.join(_dot(f'embedding[{16 * j + 1}:{16 * j + 16}]', f'q7[{16 * i + 1}:{16 * i + 16}]') for j in range(4))})" for i in range(4)), "vec_id <> 7"))
_MMR = f"""
    WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_scored(C7, "vec_id <> 7")}) JOIN (SELECT vec_id AS id, embedding AS own FROM embeddings) USING (id) ORDER BY r LIMIT 50),
    p AS (SELECT a.id AS i, b.id AS j, {_cos("a.own", "b.own")} AS likeness FROM c a JOIN c b ON a.id <> b.id),
    m AS (SELECT 1 AS step, [id] AS taken FROM c WHERE r = 1
          UNION ALL
          SELECT step + 1, list_append(taken, arg_max(id, value)) FROM (
              SELECT m.step, m.taken, c.id, 0.5 * c.score - 0.5 * max(p.likeness) AS value
              FROM m JOIN c ON NOT list_contains(m.taken, c.id) JOIN p ON p.i = c.id AND list_contains(m.taken, p.j) WHERE m.step < 10 GROUP BY m.step, m.taken, c.id, c.score)
          GROUP BY step, taken)
    SELECT id, label, round(score, 6) AS score FROM c WHERE list_contains((SELECT taken FROM m ORDER BY step DESC LIMIT 1), id)"""
seek("mmr", f"QUERY MMR POINT 7 DIVERSITY 0.5 CANDIDATES 50 {FROM} LIMIT 10", _MMR)
seek("mmr_none", f"QUERY MMR POINT 7 DIVERSITY 0.0 CANDIDATES 50 {FROM} LIMIT 10", _top(C7, "vec_id <> 7"))

# --- sparse ---------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}0-9_]+'), lambda t: strlen(t) >= 2 OR t = 'c')"


def _sparse_sql(query: str, idf: bool) -> str:
    words = tokens(query)
    weights = ", ".join(f"('{w}', (1 + ln({words.count(w)}))::DOUBLE)" for w in sorted(set(words)))
    factor = "* ln(1 + (total - n + 0.5) / (n + 0.5))" if idf else ""
    return f"""
    WITH d AS (SELECT doc_id, lang, {_TOKENS} AS ws FROM documents),
    t AS (SELECT doc_id, lang, len(ws) AS size, unnest(ws) AS w FROM d),
    f AS (SELECT doc_id, any_value(lang) AS lang, any_value(size) AS size, w, count(*) AS tf FROM t GROUP BY doc_id, w),
    q(w, qw) AS (VALUES {weights}),
    n AS (SELECT w, count(*) AS n, (SELECT count(*) FROM documents) AS total FROM f JOIN q USING (w) GROUP BY w),
    s AS (SELECT doc_id AS id, any_value(lang) AS lang,
                 sum(qw {factor} * (tf * {BM25_K1 + 1} / (tf + {BM25_K1} * ({1 - BM25_B} + {BM25_B} * size / {BM25_AVERAGE})))::FLOAT::DOUBLE) AS score
          FROM f JOIN q USING (w) JOIN n USING (w) GROUP BY doc_id)
    SELECT id, lang, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10"""


seek("sparse_bm25", f"QUERY TEXT '{SPARSE_QUERY}' FROM documents USING bm25 AS SPARSE WITH PAYLOAD INCLUDE (lang) LIMIT 10", _sparse_sql(SPARSE_QUERY, False))
seek("sparse_idf", f"QUERY TEXT '{TEXT_QUERY}' FROM documents USING idf WITH PAYLOAD INCLUDE (lang) LIMIT 10", _sparse_sql(TEXT_QUERY, True))

# --- examples -------------------------------------------------------------------------------------------------

_S = {i: _cos("embedding", f"q{i}") for i in (7, 8, 9, 42, 43, 44)}
_NOT = "vec_id NOT IN (7, 8, 42, 43)"
EXAMPLES = "POSITIVE (7, 8) NEGATIVE (42, 43)"
_AVERAGE = "list_transform(list_zip(q7, q8, q42, q43), lambda x: x[1]::DOUBLE + x[2]::DOUBLE - (x[3]::DOUBLE + x[4]::DOUBLE) / 2)"

seek("recommend_avg", f"QUERY RECOMMEND {EXAMPLES} {FROM} LIMIT 10", _top(_cos("embedding", f"({_AVERAGE})"), _NOT))
seek("recommend_avg_positive", f"QUERY RECOMMEND POSITIVE (7, 8) {FROM} LIMIT 10", _top(_cos("embedding", "(list_transform(list_zip(q7, q8), lambda x: (x[1]::DOUBLE + x[2]::DOUBLE) / 2))"), "vec_id NOT IN (7, 8)"))
_P, _N = f"greatest({_S[7]}, {_S[8]})", f"greatest({_S[42]}, {_S[43]})"
seek("recommend_best", f"QUERY RECOMMEND {EXAMPLES} STRATEGY best_score {FROM} LIMIT 10", _top(f"CASE WHEN {_P} > {_N} THEN {_P} ELSE -({_N} * {_N}) END", _NOT))
seek("recommend_sum", f"QUERY RECOMMEND {EXAMPLES} STRATEGY sum_scores {FROM} LIMIT 10", _top(f"{_S[7]} + {_S[8]} - {_S[42]} - {_S[43]}", _NOT))
PAIRS = "(POSITIVE POINT 7 NEGATIVE POINT 42, POSITIVE POINT 8 NEGATIVE POINT 43)"
seek("context", f"QUERY CONTEXT {PAIRS} {FROM} LIMIT 10", _top(f"least({_S[7]} - {_S[42]}, 0) + least({_S[8]} - {_S[43]}, 0)", _NOT))
seek("discover", f"QUERY DISCOVER TARGET POINT 9 CONTEXT {PAIRS} {FROM} LIMIT 10", _top(f"1 / (1 + exp(-{_S[9]})) + sign({_S[7]} - {_S[42]}) + sign({_S[8]} - {_S[43]})", "vec_id NOT IN (7, 8, 9, 42, 43)"))
seek("feedback", f"QUERY RELEVANCE FEEDBACK TARGET POINT 9 FEEDBACK ((POINT 7, 0.9), (POINT 8, 0.5), (POINT 42, 0.1)) STRATEGY NAIVE (a = 1.0, b = 0.5, c = 0.2) {FROM} LIMIT 10", _top(f"1.0::DOUBLE * {_S[9]} + pow(0.4::DOUBLE, 0.5) * 0.2 * ({_S[7]} - {_S[8]}) + pow(0.8::DOUBLE, 0.5) * 0.2 * ({_S[7]} - {_S[42]}) + pow(0.4::DOUBLE, 0.5) * 0.2 * ({_S[8]} - {_S[42]})", "vec_id NOT IN (7, 8, 9, 42)"))

# --- several stages -------------------------------------------------------------------------------------------

TWO = "WITH a AS (QUERY POINT 7 USING embedding LIMIT 40), b AS (QUERY POINT 42 FROM embeddings USING embedding WHERE label < 8 LIMIT 30)"
_A, _B = _ids(C7, "vec_id <> 7", 40), _ids(C42, "vec_id <> 42 AND label < 8", 30)
_LABELS = "JOIN (SELECT vec_id AS id, label FROM embeddings) USING (id)"


def _rrf_sql(a: str, b: str, k: int, wa: float, wb: float, where: str = "true") -> str:
    return f"SELECT id, label, round(score, 6) AS score FROM (SELECT id, sum(w / ({k}::DOUBLE + r)) AS score FROM (SELECT id, r, {wa}::DOUBLE AS w FROM {a} UNION ALL SELECT id, r, {wb}::DOUBLE FROM {b}) GROUP BY id) {_LABELS} WHERE {where} ORDER BY score DESC, id LIMIT 10"


def _dbsf_sql(a: str, b: str) -> str:
    part = f"(score - (avg(score) OVER () - {DBSF_SIGMAS} * stddev_samp(score) OVER ())) / ({2 * DBSF_SIGMAS} * stddev_samp(score) OVER ())"
    return f"SELECT id, label, round(score, 6) AS score FROM (SELECT id, sum(s) AS score FROM (SELECT id, {part} AS s FROM {a} UNION ALL SELECT id, {part} FROM {b}) GROUP BY id) {_LABELS} ORDER BY score DESC, id LIMIT 10"


seek("fusion_rrf", f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a, b) LIMIT 10", _rrf_sql(_A, _B, RRF_K, 1, 1))
seek("fusion_rrf_weighted", f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a, b) PARAMS (rrf_k = 30, rrf_weights = [0.7, 0.3]) LIMIT 10", _rrf_sql(_A, _B, 30, 0.7, 0.3))
seek("fusion_dbsf", f"{TWO} QUERY FUSION DBSF FROM embeddings PREFETCH (a, b) LIMIT 10", _dbsf_sql(_A, _B))
seek("fusion_filtered", f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a, b) WHERE label >= 3 LIMIT 10", _rrf_sql(_A, _B, RRF_K, 1, 1, "label >= 3"))
seek("prefetch_override", f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a WHERE label = 2, b SCORE THRESHOLD 0.05) LIMIT 10", _rrf_sql(_ids(C7, "vec_id <> 7 AND label = 2", 40), f"(SELECT * FROM {_ids(C42, f'vec_id <> 42 AND label < 8 AND {_cos('embedding', _v(42))} >= 0.05', 30)})", RRF_K, 1, 1))
seek("prefetch_rescore", f"QUERY POINT 42 {FROM} PREFETCH (QUERY POINT 7 USING embedding LIMIT 50) LIMIT 10", f"SELECT id, label, round(score, 6) AS score FROM ({_scored(C42, 'vec_id <> 42')}) WHERE id IN (SELECT id FROM {_ids(C7, 'vec_id <> 7', 50)}) ORDER BY score DESC, id LIMIT 10")
seek("cte_chain", f"WITH a AS (QUERY POINT 7 USING embedding LIMIT 100), b AS (QUERY POINT 42 USING embedding PREFETCH (a) LIMIT 30) QUERY POINT 9 {FROM} PREFETCH (b) LIMIT 10", f"SELECT id, label, round(score, 6) AS score FROM ({_scored(_S[9], 'vec_id <> 9')}) WHERE id IN (SELECT id FROM ({_scored(C42, 'vec_id <> 42')}) WHERE id IN (SELECT id FROM {_ids(C7, 'vec_id <> 7', 100)}) ORDER BY score DESC, id LIMIT 30) ORDER BY score DESC, id LIMIT 10")
seek("rerank_maxsim", "QUERY RERANK POINT 42 MODEL 'late' FROM embeddings USING parts PREFETCH (QUERY POINT 7 USING embedding LIMIT 50) LIMIT 10", f"SELECT id, label, round(score, 6) AS score FROM ({_scored(' + '.join(f'greatest({", ".join(_dot(f"embedding[{16 * j + 1}:{16 * j + 16}]", f"q42[{16 * i + 1}:{16 * i + 16}]") for j in range(4))})' for i in range(4)), 'vec_id <> 42')}) WHERE id IN (SELECT id FROM {_ids(C7, 'vec_id <> 7', 50)}) ORDER BY score DESC, id LIMIT 10")

_CROSS = f"""
    WITH c AS (SELECT doc_id, text FROM documents WHERE n_chars < 400 AND lang = 'en' ORDER BY n_chars, doc_id LIMIT 60),
    d AS (SELECT doc_id, text, list_distinct({_TOKENS}) AS ws FROM c WHERE trim(text) <> ''),
    q AS (SELECT {sorted(set(tokens(TEXT_QUERY)))}::VARCHAR[] AS qs)
    SELECT doc_id::VARCHAR AS id, 'documents' AS collection, text, round(len(list_intersect(ws, qs)) / (1.0::DOUBLE + len(ws) + len(qs) - len(list_intersect(ws, qs))), 6) AS score
    FROM d, q ORDER BY len(list_intersect(ws, qs)) / (1.0::DOUBLE + len(ws) + len(qs) - len(list_intersect(ws, qs))) DESC, id LIMIT 10"""
seek("cross_rerank_two", f"QUERY CROSS RERANK '{TEXT_QUERY}' MODEL 'overlap' FROM documents PREFETCH (QUERY ORDER BY n_chars FROM documents WHERE n_chars < 400 AND lang = 'en' LIMIT 60, QUERY ORDER BY n_chars FROM documents WHERE n_chars < 400 AND lang = 'en' LIMIT 40 OFFSET 30) LIMIT 10", _CROSS.replace("LIMIT 60", "LIMIT 70"))
seek("cross_rerank", f"QUERY CROSS RERANK '{TEXT_QUERY}' MODEL 'overlap' FROM documents PREFETCH (QUERY ORDER BY n_chars FROM documents WHERE n_chars < 400 AND lang = 'en' LIMIT 60) LIMIT 10", _CROSS)


class _Numbers(Embedder):
    """Every text is the same dense vector, so SQL can follow it."""

    def dense(self, texts, model, size):
        return [[3.0, 5.0, 7.0, 1.0] for _ in texts]


def _hybrid(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _read(spark, sf_dir, "documents")
        numbers = F.array(*(x.cast("float") for x in (F.col("n_chars") % 7, F.col("doc_id") % 11, F.col("doc_id") % 13, F.lit(1))))
        both = docs.withColumn("dense", numbers)
        e = Engine(spark, _Numbers())
        e.register("both", both, "doc_id", {"dense": VectorDef(size=4), "sparse": VectorDef("sparse", idf=True, column="text", encoding="bm25")}, payload=["lang"])
        return _rounded(e.query(f"QUERY TEXT '{TEXT_QUERY}' FROM both USING HYBRID FUSION {method} WHERE lang = 'en' LIMIT 10"))

    return run


def _hybrid_sql(method: str) -> str:
    sparse = _sparse_sql(TEXT_QUERY, True).replace("SELECT id, lang, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10", "")
    cos = "((n_chars % 7) * 3.0::DOUBLE + (doc_id % 11) * 5 + (doc_id % 13) * 7 + 1) / (sqrt(84.0::DOUBLE) * sqrt(pow(n_chars % 7, 2) + pow(doc_id % 11, 2) + pow(doc_id % 13, 2) + 1))"
    part = f"1.0::DOUBLE / ({RRF_K} + r)" if method == "RRF" else f"(score - (avg(score) OVER () - {DBSF_SIGMAS} * stddev_samp(score) OVER ())) / ({2 * DBSF_SIGMAS} * stddev_samp(score) OVER ())"
    return f"""{sparse},
    a AS (SELECT doc_id AS id, {cos} AS score, row_number() OVER (ORDER BY {cos} DESC, doc_id) AS r FROM documents WHERE lang = 'en' ORDER BY r LIMIT 100),
    b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE lang = 'en' ORDER BY r LIMIT 100),
    fused AS (SELECT id, sum(p) AS score FROM (SELECT id, {part} AS p FROM a UNION ALL SELECT id, {part} FROM b) GROUP BY id)
    SELECT id, 'en' AS lang, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, id LIMIT 10"""


for _method in ("RRF", "DBSF"):
    QUERIES[f"hybrid_{_method.lower()}"] = _hybrid(_method)
    ORACLE[f"hybrid_{_method.lower()}"] = _hybrid_sql(_method)

# --- groups ---------------------------------------------------------------------------------------------------

_RANKED = f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM ({_scored(C7, 'vec_id <> 7')})"


def _groups_sql(size: int, limit: int, offset: int = 0, key: str = "label", extra: str = "", join: str = "", source: str = _RANKED) -> str:
    return f"""WITH r AS ({source}), g AS (SELECT {key} AS group_id, row_number() OVER (ORDER BY score DESC, id, {key}) AS place FROM r WHERE rank = 1)
    SELECT r.id, round(r.score, 6) AS score, g.group_id, g.place - {offset} AS group_rank, r.rank, r.label{extra} FROM r JOIN g ON r.{key} = g.group_id {join} WHERE rank <= {size} AND place > {offset} AND place <= {offset + limit}"""


seek("group_by", f"QUERY POINT 7 {FROM} GROUP BY label LIMIT 4", _groups_sql(3, 4))
seek("group_size", f"QUERY POINT 7 {FROM} GROUP BY label SIZE 5", _groups_sql(5, 10))
seek("group_offset", f"QUERY POINT 7 {FROM} GROUP BY label SIZE 2 LIMIT 3 OFFSET 2", _groups_sql(2, 3, 2))
seek("group_lookup", f"QUERY POINT 7 {FROM} GROUP BY label SIZE 2 LOOKUP FROM nation LIMIT 5", _groups_sql(2, 5, extra=", n_name AS lookup_name", join="LEFT JOIN nation ON n_nationkey = g.group_id"), lambda df: df.withColumn("lookup_name", F.col("lookup.n_name")).drop("lookup"))
_TAGGED = f"SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) AS rank FROM (SELECT id, label, score, unnest(list_distinct([id % 5, id % 7 + 10])) AS tag FROM ({_scored(C7, 'vec_id <> 7')}))"
seek("group_multivalue", "QUERY POINT 7 FROM shaped USING embedding GROUP BY tags SIZE 2 WITH PAYLOAD INCLUDE (label) LIMIT 6", _groups_sql(2, 6, key="tag", source=_TAGGED))

# --- formulas -------------------------------------------------------------------------------------------------

_PRE = "PREFETCH (QUERY POINT 7 USING embedding LIMIT 40)"


def formula(name: str, text: str, sql: str, more: str = "") -> None:
    """Over the 40 nearest to point 7, whose score is `s`; `label` and `id` are payload and id."""
    seek(f"formula_{name}", f"QUERY FORMULA {text} {more} FROM embeddings {_PRE} LIMIT 10", f"SELECT id, label, round(score, 6) AS score FROM (SELECT id, label, {sql} AS score FROM (SELECT id, score AS s FROM {_ids(C7, 'vec_id <> 7', 40)}) {_LABELS}) ORDER BY score DESC, id LIMIT 10")


formula("arith", "$score * 2.0 + label / 10.0 - 1.0", "s * 2 + label::DOUBLE / 10 - 1")
formula("case", "CASE WHEN label BETWEEN 2 AND 4 THEN $score * 3.0 ELSE -$score END", "CASE WHEN label BETWEEN 2 AND 4 THEN s * 3 ELSE -s END")
formula("div_default", "$score / label [DEFAULT = 0.5]", "CASE WHEN label = 0 THEN 0.5 ELSE s / label::DOUBLE END")
formula("math", "ABS($score) + SQRT(label) + LN(label + 1.0) + LOG(label + 1.0) + EXP($score) + POW(label, 2.0)", "abs(s) + sqrt(label) + ln(label + 1.0::DOUBLE) + log10(label + 1.0::DOUBLE) + exp(s) + pow(label::DOUBLE, 2)")
formula("decay_exp", "EXP_DECAY(label, 4.0, 2.0, 0.5) + $score", "exp(ln(0.5::DOUBLE) / 2 * abs(label - 4.0::DOUBLE)) + s")
formula("decay_gauss", "GAUSS_DECAY(x = label, target = 4.0, scale = 3.0, decay = 0.25)", "exp(ln(0.25::DOUBLE) / 9 * pow(label - 4.0::DOUBLE, 2))")
formula("decay_lin", "LIN_DECAY(label, 4.0, 3.0) * $score", "greatest(0, 1 - 0.5::DOUBLE / 3 * abs(label - 4.0::DOUBLE)) * s")
formula("match", "MATCH(label, 3) * 2.0 + MATCH_ANY(label, [4, 5]) + $score", "(label = 3)::INT * 2.0::DOUBLE + (label IN (4, 5))::INT + s")
formula("defaults", "boost * $score + label", "2.5::DOUBLE * s + label", "DEFAULTS (boost = 2.5)")
seek("formula_payload", "QUERY FORMULA score + o_totalprice / 1000.0 DEFAULTS (score = 1.5) FROM orders WHERE o_orderstatus = 'F' WITH PAYLOAD INCLUDE (o_custkey) LIMIT 10", "SELECT o_orderkey AS id, o_custkey, round(1.5 + o_totalprice / 1000, 6) AS score FROM orders WHERE o_orderstatus = 'F' ORDER BY 1.5 + o_totalprice / 1000 DESC, o_orderkey LIMIT 10")
seek("formula_datetime", "QUERY FORMULA (datetime('1995-01-01T00:00:00Z') - datetime_key('o_orderdate')) / 86400.0 FROM orders WITH PAYLOAD INCLUDE (o_custkey) LIMIT 10", "SELECT o_orderkey AS id, o_custkey, round((788918400 - epoch_us(o_orderdate) / 1e6) / 86400, 6) AS score FROM orders ORDER BY (788918400 - epoch_us(o_orderdate) / 1e6) / 86400 DESC, o_orderkey LIMIT 10")
_LAT, _LON = "((vec_id * 7919 % 18000) / 100.0::DOUBLE - 90)", "((vec_id * 104729 % 36000) / 100.0::DOUBLE - 180)"


def _haversine(lat: float, lon: float) -> str:
    return f"(2 * {EARTH_RADIUS_M} * asin(sqrt(least(pow(sin((radians({_LAT}) - radians({lat}::DOUBLE)) / 2), 2) + cos(radians({_LAT})) * cos(radians({lat}::DOUBLE)) * pow(sin((radians({_LON}) - radians({lon}::DOUBLE)) / 2), 2), 1.0))))"


seek("formula_geo_distance", "QUERY FORMULA -GEO_DISTANCE({lat: 48.1, lon: 11.6}, place) / 1000.0 FROM shaped WITH PAYLOAD INCLUDE (label) LIMIT 10", f"SELECT vec_id AS id, label, round(-{_haversine(48.1, 11.6)} / 1000, 6) AS score FROM embeddings ORDER BY {_haversine(48.1, 11.6)}, vec_id LIMIT 10")

# --- points, pages, counts ------------------------------------------------------------------------------------

seek("count_all", "COUNT FROM lineitem", "SELECT count(*) AS count FROM lineitem")
seek("count_filtered", "COUNT FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R' WITH (exact = true)", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
seek("count_shard", "COUNT FROM shaped SHARD '1'", "SELECT count(*) AS count FROM embeddings WHERE vec_id % 3 = 1")
seek("scroll", "SCROLL FROM customer WHERE c_mktsegment = 'BUILDING' LIMIT 25", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 25")
seek("scroll_after", "SCROLL FROM customer AFTER 100 LIMIT 20", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey >= 100 ORDER BY 1 LIMIT 20")
seek("points", "QUERY POINTS (3, 14, 15, 92, 100000000) FROM customer WITH PAYLOAD INCLUDE (c_name, c_acctbal)", "SELECT c_custkey AS id, c_name, c_acctbal FROM customer WHERE c_custkey IN (3, 14, 15, 92)")
seek("order_by_asc", "QUERY ORDER BY o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' WITH PAYLOAD INCLUDE (o_totalprice) LIMIT 15 OFFSET 5", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 5")
seek("order_by_desc", "QUERY ORDER BY o_totalprice DESC FROM orders WITH PAYLOAD INCLUDE (o_totalprice) LIMIT 15", "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
seek("sample", "QUERY SAMPLE RANDOM FROM customer WHERE c_acctbal > 0 LIMIT 30", "SELECT least(count(*), 30) AS n, least(count(*), 30) AS good FROM customer WHERE c_acctbal > 0", lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good")))

# --- filters --------------------------------------------------------------------------------------------------


def counted(name: str, collection: str, where: str, sql: str, table: str | None = None) -> None:
    """A filter by what it keeps: how many points, and the sum of the ids on the first page of 100."""
    key = {"lineitem": "l_orderkey * 10 + l_linenumber", "documents": "doc_id", "shaped": "vec_id", "halves": "vec_id"}.get(collection, IDS.get(collection, "vec_id"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        n = e.query(f"COUNT FROM {collection} WHERE {where}").select(F.col("count").alias("n"))
        ids = e.query(f"SCROLL FROM {collection} WHERE {where} LIMIT 100").agg(F.sum("id").cast("long").alias("ids"))
        return n.join(F.broadcast(ids))  # one row each

    QUERIES[f"filter_{name}"] = run
    rows = f"SELECT {key} AS id FROM {table or collection} WHERE {sql}"
    ORACLE[f"filter_{name}"] = f"SELECT (SELECT count(*) FROM ({rows})) AS n, (SELECT sum(id)::BIGINT FROM (SELECT id FROM ({rows}) ORDER BY id LIMIT 100)) AS ids"


E_ = "embeddings"
counted("eq", "orders", "o_orderstatus = 'F'", "o_orderstatus = 'F'")
counted("ne", "shaped", "maybe != 3", "NOT coalesce(vec_id % 4 <> 0 AND vec_id % 10 = 3, false)", E_)
counted("range", "lineitem", "l_discount >= 0.05 AND l_discount < 0.08 AND l_quantity <= 20", "l_discount >= 0.05 AND l_discount < 0.08 AND l_quantity <= 20")
counted("between", "orders", "o_totalprice BETWEEN 50000.0 AND 100000.0", "o_totalprice BETWEEN 50000 AND 100000")
counted("date", "orders", "o_orderdate >= '1995-01-01T00:00:00' AND o_orderdate < '1996-01-01T00:00:00'", "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
counted("in", "part", "p_size IN (1, 5, 9, 15)", "p_size IN (1, 5, 9, 15)")
counted("not_in", "shaped", "maybe NOT IN (1, 2, 3)", "NOT coalesce(vec_id % 4 <> 0 AND vec_id % 10 IN (1, 2, 3), false)", E_)
counted("null", "shaped", "maybe IS NULL", "vec_id % 4 = 0", E_)
counted("not_null", "shaped", "maybe IS NOT NULL", "vec_id % 4 <> 0", E_)
counted("empty", "shaped", "some IS EMPTY", "vec_id % 3 = 0", E_)
counted("not_empty", "shaped", "some IS NOT EMPTY", "vec_id % 3 <> 0", E_)
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
counted("match", "documents", "text MATCH 'The AND of'", f"list_has_all({_WORDS}, ['the', 'and', 'of'])")
counted("match_any", "documents", "lang MATCH ANY ('fr', 'de')", "lang IN ('fr', 'de')")
counted("match_phrase", "documents", "text MATCH PHRASE 'of the'", f"contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')")
counted("and_or_not", "orders", "NOT (o_orderstatus = 'F' AND o_totalprice > 100000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 500)", "NOT (o_orderstatus = 'F' AND o_totalprice > 100000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 500)")
counted("array_any", "shaped", "tags = 3 OR tags > 15", "vec_id % 5 = 3 OR vec_id % 7 + 10 > 15 OR vec_id % 5 > 15", E_)
counted("nested", "shaped", "NESTED('items', label = 4 AND rank = 2)", "(label = 4 AND vec_id % 5 = 2) OR (label + 1 = 4 AND vec_id % 3 = 2)", E_)
counted("path", "shaped", "items[].rank = 4 AND place.lat > 0", f"vec_id % 5 = 4 AND {_LAT} > 0", E_)
counted("values_count", "shaped", "some VALUES_COUNT = 1 AND tags VALUES_COUNT >= 2", "vec_id % 3 <> 0", E_)
counted("has_vector", "halves", "HAS_VECTOR half", "vec_id % 2 = 0", E_)
counted("id_in", "orders", "id IN (1, 2, 3, 33) AND id != 2", "o_orderkey IN (1, 3, 33)")
counted("geo_radius", "shaped", "place GEO_RADIUS {center: {lat: 48.1, lon: 11.6}, radius: 4000000.0}", f"{_haversine(48.1, 11.6)} <= 4000000", E_)
counted("geo_bbox", "shaped", "place GEO_BBOX {top_left: {lat: 60.0, lon: 150.0}, bottom_right: {lat: -40.0, lon: -150.0}}", f"{_LAT} BETWEEN -40 AND 60 AND ({_LON} >= 150 OR {_LON} <= -150)", E_)
counted("geo_polygon", "shaped", "place GEO_POLYGON {exterior: [{lat: -50.0, lon: -60.0}, {lat: -50.0, lon: 60.0}, {lat: 50.0, lon: 60.0}, {lat: 50.0, lon: -60.0}], interiors: [[{lat: -10.0, lon: -10.0}, {lat: -10.0, lon: 10.0}, {lat: 10.0, lon: 10.0}, {lat: 10.0, lon: -10.0}]]}", f"{_LAT} >= -50 AND {_LAT} < 50 AND {_LON} >= -60 AND {_LON} < 60 AND NOT ({_LAT} >= -10 AND {_LAT} < 10 AND {_LON} >= -10 AND {_LON} < 10)", E_)

# --- selectors ------------------------------------------------------------------------------------------------

seek("select_none", "QUERY ORDER BY p_retailprice DESC FROM part WITH PAYLOAD false LIMIT 12", "SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
seek("select_include", "QUERY ORDER BY p_retailprice DESC FROM part WITH PAYLOAD INCLUDE (p_name, p_brand) LIMIT 12", "SELECT p_partkey AS id, p_name, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12")
seek("select_exclude", "QUERY ORDER BY p_retailprice FROM part WITH PAYLOAD EXCLUDE (p_name, p_type) LIMIT 12", "SELECT p_partkey AS id, p_brand, p_size, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 12")
seek("select_vectors", "QUERY POINT 7 FROM halves USING embedding WITH VECTOR (half) LIMIT 8", f"SELECT s.id, s.label, s.score, round(e.embedding[1]::DOUBLE, 6) AS first_value FROM ({_top(C7, 'vec_id <> 7', 8)}) s LEFT JOIN embeddings e ON e.vec_id = s.id AND s.id % 2 = 0", lambda df: df.withColumn("first_value", F.round(F.get("half", F.lit(0)).cast("double"), 6)).drop("half"))

# --- changes --------------------------------------------------------------------------------------------------


def changed(name: str, script: str, ask: Callable[[Engine], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        report = e.execute(script)
        if not report.ok:
            raise report.results[-1].error
        return ask(e)

    QUERIES[name] = run
    ORACLE[name] = sql


def _supplier(e: Engine) -> DataFrame:
    return e.collection("supplier").rows.agg(F.count(F.lit(1)).alias("n"), F.count("s_name").alias("names"), F.round(F.sum("s_acctbal"), 4).alias("balance"), F.sum("__id").cast("long").alias("ids"))


def _supplier_sql(rows: str) -> str:
    return f"SELECT count(*) AS n, count(s_name) AS names, round(sum(s_acctbal), 4) AS balance, sum(s_suppkey)::BIGINT AS ids FROM ({rows})"


changed("upsert_then_count", "UPSERT INTO supplier VALUES {id: 3, s_name: 'new', s_nationkey: 1, s_acctbal: 10.5}, {id: 900000001, s_name: 'other', s_acctbal: 1.25}, {id: 900000001, s_name: 'last', s_acctbal: 2.25}", _supplier, _supplier_sql("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey <> 3 UNION ALL VALUES (3, 'new', 10.5), (900000001, 'last', 2.25)"))
def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement with 20,000 points, half of them over stored ones."""
    e = engine(spark, sf_dir)
    points = ", ".join(f"{{id: {i}, s_name: 'p{i}', s_nationkey: {i % 25}, s_acctbal: {i % 1000}.25}}" for i in range(50, 20_050))
    report = e.execute(f"UPSERT INTO supplier VALUES {points}")
    if not report.ok:
        raise report.results[-1].error
    return _supplier(e)


QUERIES["upsert_large"] = _large
ORACLE["upsert_large"] = _supplier_sql("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey NOT BETWEEN 50 AND 20049 UNION ALL SELECT i, 'p' || i, i % 1000 + 0.25 FROM range(50, 20050) t(i)")


def _restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second engine at the path of the first answers for what that one stored."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/kept-{uuid.uuid4().hex}"
    first = Engine(spark, path=path)
    first.register("supplier", _read(spark, sf_dir, "supplier"), "s_suppkey")
    if not first.execute("UPSERT INTO supplier VALUES {id: 3, s_name: 'new', s_nationkey: 1, s_acctbal: 10.5}; DELETE FROM supplier WHERE s_nationkey = 4").ok:
        raise RuntimeError("the changes failed")
    return _supplier(Engine(spark, path=path))


QUERIES["upsert_after_restart"] = _restarted
ORACLE["upsert_after_restart"] = _supplier_sql("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey <> 3 AND s_nationkey <> 4 UNION ALL VALUES (3, 'new', 10.5)")
changed("delete_then_count", "DELETE FROM supplier WHERE s_acctbal < 0.0; DELETE FROM supplier WHERE id IN (1, 2)", _supplier, _supplier_sql("SELECT * FROM supplier WHERE NOT s_acctbal < 0 AND s_suppkey NOT IN (1, 2)"))
changed("update_payload", "UPDATE supplier SET PAYLOAD = {s_acctbal: 5.5, s_name: 'same'} WHERE s_nationkey = 3", _supplier, _supplier_sql("SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN 5.5 ELSE s_acctbal END AS s_acctbal FROM supplier"))
changed("clear_payload", "CLEAR PAYLOAD FROM supplier WHERE s_nationkey IN (1, 2, 3)", _supplier, _supplier_sql("SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (1, 2, 3) THEN s_name END AS s_name, CASE WHEN s_nationkey NOT IN (1, 2, 3) THEN s_acctbal END AS s_acctbal FROM supplier"))
changed("delete_payload", "DELETE PAYLOAD s_name FROM supplier WHERE s_acctbal > 5000.0", _supplier, _supplier_sql("SELECT s_suppkey, CASE WHEN NOT s_acctbal > 5000 THEN s_name END AS s_name, s_acctbal FROM supplier"))
_NEW = "[" + ", ".join(["1.0"] + ["0.0"] * 63) + "]"


def _near_first(e: Engine) -> DataFrame:
    return _rounded(e.query(f"QUERY VECTOR {_NEW} FROM halves USING half LIMIT 5"))


_HALF = _cos("embedding", f"{_NEW}::DOUBLE[]")
changed("update_vector", f"UPDATE halves SET VECTOR half = {_NEW} WHERE id = 7", _near_first, f"SELECT id, label, round(score, 6) AS score FROM ({_scored(_HALF, 'vec_id % 2 = 0')} UNION ALL SELECT 7, label, 1.0 FROM embeddings WHERE vec_id = 7) ORDER BY score DESC, id LIMIT 5")
changed("delete_vector", "DELETE VECTOR half FROM halves WHERE label = 2", _near_first, _top(_HALF, "vec_id % 2 = 0 AND label <> 2", 5))


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inject_filter(parse_one(f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a, b WHERE label > 1) LIMIT 10"), "label", "in", (2, 4, 6))
    return _rounded(engine(spark, sf_dir).query(s))


QUERIES["inject_filter_query"] = _injected
ORACLE["inject_filter_query"] = _rrf_sql(_ids(C7, "vec_id <> 7 AND label IN (2, 4, 6)", 40), _ids(C42, "vec_id <> 42 AND label IN (2, 4, 6)", 30), RRF_K, 1, 1, "label IN (2, 4, 6)")


# --- definitions, scripts, embeddings -------------------------------------------------------------------------


def scripted(name: str, script: str, sql: str, embedder: Embedder | None = None) -> None:
    """A script on a new engine, and the rows of its last statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        report = Engine(spark, embedder).execute(script)
        if not report.ok:
            raise report.results[-1].error
        return report.results[-1].data

    QUERIES[name] = run
    ORACLE[name] = sql


_DEFINED = """
CREATE COLLECTION c (v VECTOR(3, COSINE), s SPARSE WITH SPARSE (modifier = 'idf')) WITH HNSW (m = 8);
CREATE COLLECTION gone HYBRID RERANK; CREATE INDEX ON COLLECTION c FOR a TYPE keyword; CREATE INDEX ON COLLECTION c FOR b TYPE integer; DROP INDEX ON COLLECTION c FOR b;
ALTER COLLECTION c WITH HNSW (m = 16) WITH OPTIMIZERS (indexing_threshold = 5); CREATE SHARD KEY 'one' ON COLLECTION c; CREATE SHARD KEY 'two' ON COLLECTION c; DROP SHARD KEY 'one' ON COLLECTION c; DROP COLLECTION gone;
"""
scripted("show_collections", _DEFINED + "SHOW COLLECTIONS", "SELECT * FROM (VALUES ('c')) t(name)")
scripted("show_shard_keys", _DEFINED + "SHOW SHARD KEYS ON COLLECTION c", "SELECT * FROM (VALUES ('two')) t(shard_key)")
scripted("show_collection", _DEFINED + "SHOW COLLECTION c", "SELECT * FROM (VALUES ('vector', 'v', 'dense(3, COSINE)'), ('vector', 's', 'sparse(idf=true)'), ('index', 'a', 'keyword'), ('config', 'HNSW.m', '16'), ('config', 'OPTIMIZERS.indexing_threshold', '5')) t(part, name, value)")
_TEXTS = "{id: 1, text: 'red fox and fox'}, {id: 2, body: 'blue cat'}, {id: 3, text: 'red cat'}, {id: 4, n: 5}"
scripted("upsert_embedded", f"UPSERT INTO made VALUES {_TEXTS}; COUNT FROM made WHERE HAS_VECTOR dense AND HAS_VECTOR sparse", "SELECT 3 AS count")
scripted("upsert_specified", f"CREATE COLLECTION m HYBRID RERANK; UPSERT INTO m VALUES {_TEXTS.replace(', {id: 4, n: 5}', '')} USING HYBRID, MULTI INTO colbert; COUNT FROM m WHERE HAS_VECTOR dense AND HAS_VECTOR sparse AND HAS_VECTOR colbert", "SELECT 3 AS count")
scripted("shard_scroll", "CREATE COLLECTION k (v VECTOR(1, DOT)); CREATE SHARD KEY 'a' ON COLLECTION k; UPSERT INTO k VALUES {id: 1, vector: {v: [1]}}, {id: 2, vector: {v: [2]}} SHARD 'a'; UPSERT INTO k VALUES {id: 3, vector: {v: [3]}}; QUERY VECTOR [1.0] FROM k USING v SHARD 'a' WITH PAYLOAD false LIMIT 5", "SELECT * FROM (VALUES ('1', 1.0::DOUBLE), ('2', 2.0)) t(id, score)")

FAILING = {
    "COLLECTION": "COUNT FROM nothing", "VALIDATION-VECTOR": "UPSERT INTO c VALUES {id: 1, vector: {v: [1, 2]}}", "UNKNOWN-VECTOR": "QUERY POINT 1 FROM c USING w", "VALIDATION-LIMIT-OVERFLOW": "QUERY 'a' FROM c LIMIT 18446744073709551615 OFFSET 2",
    "EMBEDDING-SPARSE-MODEL": "QUERY TEXT 'x' MODEL 'other' FROM c USING s AS SPARSE", "VALIDATION-CONFIG": "CREATE COLLECTION d (v VECTOR(3, DOT)) WITH HNSW (m = 'x')", "SHARD": "CREATE SHARD KEY 'two' ON COLLECTION c", "INDEX": "DROP INDEX ON COLLECTION c FOR b",
}


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each statement that must fail; those that don't parse fail before any runs."""
    e, found = Engine(spark), []
    e.execute(_DEFINED)
    for statement in FAILING.values():
        try:
            report = e.execute(statement)
            found.append((statement, report.results[-1].error.code if report.results[-1].error else "none"))
        except SeekError as error:
            found.append((statement, error.code))
    return spark.createDataFrame(found, "statement string, code string")


QUERIES["errors"] = _failures
ORACLE["errors"] = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(v.replace("'", "''"), k) for k, v in FAILING.items()) + ") t(statement, code)"

ROUTED = {
    "QUERY 'a' FROM c": ("query", "POST", "/collections/c/points/query"), "QUERY 'a' FROM c GROUP BY x": ("query_groups", "POST", "/collections/c/points/query/groups"), "QUERY POINTS (1) FROM c": ("points", "POST", "/collections/c/points"), "SCROLL FROM c LIMIT 5": ("scroll", "POST", "/collections/c/points/scroll"),
    "COUNT FROM c": ("count", "POST", "/collections/c/points/count"), "UPSERT INTO c VALUES {id: 1}": ("upsert", "PUT", "/collections/c/points"), "DELETE FROM c WHERE id = 1": ("delete", "POST", "/collections/c/points/delete"), "CLEAR PAYLOAD FROM c WHERE id = 1": ("clear_payload", "POST", "/collections/c/points/payload/clear"),
    "UPDATE c SET PAYLOAD = {a: 1} WHERE id = 1": ("update_payload", "POST", "/collections/c/points/payload"), "DELETE PAYLOAD a FROM c WHERE id = 1": ("delete_payload", "POST", "/collections/c/points/payload/delete"), "UPDATE c SET VECTOR v = [1] WHERE id = 1": ("update_vector", "PUT", "/collections/c/points/vectors"),
    "DELETE VECTOR v FROM c WHERE id = 1": ("delete_vector", "POST", "/collections/c/points/vectors/delete"), "CREATE COLLECTION c HYBRID": ("create_collection", "PUT", "/collections/c"), "ALTER COLLECTION c WITH HNSW (m = 4)": ("update_collection", "PATCH", "/collections/c"), "DROP COLLECTION c": ("drop_collection", "DELETE", "/collections/c"),
    "CREATE INDEX ON COLLECTION c FOR a TYPE text": ("create_index", "PUT", "/collections/c/index"), "DROP INDEX ON COLLECTION c FOR a": ("drop_index", "DELETE", "/collections/c/index/a"), "SHOW COLLECTIONS": ("show_collections", "GET", "/collections"), "SHOW COLLECTION c": ("show_collection", "GET", "/collections/c"),
}


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(q, c["stmt_type"], c["method"], c["path"]) for q in ROUTED for c in Engine.compile(q)]
    return spark.createDataFrame(found, "statement string, stmt_type string, method string, path string")


QUERIES["compiled_routes"] = _routes
ORACLE["compiled_routes"] = "SELECT * FROM (VALUES " + ", ".join("({})".format(", ".join("'{}'".format(x.replace("'", "''")) for x in (q, *r))) for q, r in ROUTED.items()) + ") t(statement, stmt_type, method, path)"


def _dumped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection as a script in a folder, run by another engine, which then answers."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/dump-{uuid.uuid4().hex}"
    dump_folder(engine(spark, sf_dir).collection("halves"), folder)
    other = Engine(spark)
    restore(other, folder)
    Files(spark).remove(folder)
    return _rounded(other.query(f"QUERY VECTOR {_NEW} FROM halves USING half WITH PAYLOAD INCLUDE (label) LIMIT 5")).withColumn("label", F.col("label").cast("long"))


QUERIES["dump_restored"] = _dumped
ORACLE["dump_restored"] = f"SELECT id::VARCHAR AS id, label::BIGINT AS label, score FROM ({_top(_HALF, 'vec_id % 2 = 0', 5)})"

_REQUEST = {"method": "POST", "path": "/collections/embeddings/points/search", "body": {"vector": {"name": "embedding", "vector": VECTOR}, "filter": {"must": [{"key": "label", "match": {"any": [3, 5]}}], "must_not": [{"has_id": [1, 2]}]}, "limit": 10}}


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine(spark, sf_dir).query(convert_request(_REQUEST)[0]))


QUERIES["converted_request"] = _converted
ORACLE["converted_request"] = _top(_cos("embedding", f"{LITERAL}::DOUBLE[]"), "label IN (3, 5) AND vec_id NOT IN (1, 2)")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of a scroll, each from the cursor of the one before."""
    e, found, after = engine(spark, sf_dir), [], 3
    for number in range(3):
        rows, after = e.page(f"SCROLL FROM part WHERE p_size < 40 AFTER {after} LIMIT 25")
        found += [(number, r["id"]) for r in rows.select("id").collect()]
    return spark.createDataFrame(found, "page int, id long")


QUERIES["scroll_pages"] = _paged
ORACLE["scroll_pages"] = "SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // 25)::INT AS page, p_partkey AS id FROM part WHERE p_size < 40 AND p_partkey >= 3 ORDER BY id LIMIT 75"


class _Pictures(Embedder):
    """Every image is the same vector."""

    def image(self, sources, model, size):
        return [[3.0, 5.0, 7.0, 1.0] for _ in sources]


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    numbers = F.array(*(x.cast("float") for x in (F.col("n_chars") % 7, F.col("doc_id") % 11, F.col("doc_id") % 13, F.lit(1))))
    e = Engine(spark, _Pictures())
    e.register("pictures", docs.withColumn("dense", numbers), "doc_id", {"dense": VectorDef(size=4)}, payload=["lang"])
    return _rounded(e.query("QUERY IMAGE 'x.png' MODEL 'm' FROM pictures USING dense WHERE lang = 'en' LIMIT 10"))


QUERIES["image_nearest"] = _image
ORACLE["image_nearest"] = "SELECT id, lang, round(score, 6) AS score FROM (SELECT doc_id AS id, lang, ((n_chars % 7) * 3.0::DOUBLE + (doc_id % 11) * 5 + (doc_id % 13) * 7 + 1) / (sqrt(84.0::DOUBLE) * sqrt(pow(n_chars % 7, 2) + pow(doc_id % 11, 2) + pow(doc_id % 13, 2) + 1)) AS score FROM documents WHERE lang = 'en') ORDER BY -score, id LIMIT 10"

# --- one for all ----------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources fused by rank, filtered and grouped."""
    return _rounded(engine(spark, sf_dir).query(f"{TWO} QUERY FUSION RRF FROM embeddings PREFETCH (a, b) WHERE label >= 1 GROUP BY label SIZE 2 LIMIT 5"))


_FUSED = f"SELECT * FROM (SELECT id, sum(1.0::DOUBLE / ({RRF_K}::DOUBLE + r)) AS score FROM (SELECT id, r FROM {_A} UNION ALL SELECT id, r FROM {_B}) GROUP BY id) {_LABELS} WHERE label >= 1"
QUERIES["flagship"] = flagship
ORACLE["flagship"] = _groups_sql(2, 5, source=f"SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM ({_FUSED})")
