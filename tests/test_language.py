"""The language: every production once, and an error of each family."""

from __future__ import annotations

import pytest

from sparkseek import nodes as n
from sparkseek.errors import SeekError
from sparkseek.functions.text import document_vector, query_vector, token_index, tokens
from sparkseek.inject import get_shard, inject_filter, set_shard
from sparkseek.lexer import tokenize
from sparkseek.nodes import to_json
from sparkseek.parser import is_valid, parse, parse_one

VALID = [
    "QUERY 'a' FROM c", "QUERY NEAREST TEXT 'a' MODEL 'm' FROM c USING v AS DENSE LIMIT 3 OFFSET 2", "QUERY IMAGE 'x.png' FROM c USING v",
    "QUERY VECTOR [1, -2.5, 3e-2] FROM c", "QUERY VECTOR {indices: [1, 4], values: [0.5, 1]} FROM c USING s AS SPARSE", "QUERY VECTOR [[1, 2], [3, 4]] FROM c USING m AS MULTIVECTOR",
    "QUERY POINT 'id' FROM c", "QUERY POINTS (1, 'b') FROM c SHARD 'x' WITH PAYLOAD true WITH VECTOR", "QUERY RECOMMEND POSITIVE (1) NEGATIVE (2, 3) STRATEGY sum_scores FROM c",
    "QUERY CONTEXT (POSITIVE POINT 1 NEGATIVE TEXT 'x') FROM c", "QUERY DISCOVER TARGET 'x' CONTEXT (POSITIVE POINT 1 NEGATIVE POINT 2) FROM c", "QUERY ORDER BY a.b DESC FROM c", "QUERY SAMPLE RANDOM FROM c",
    "WITH a AS (QUERY 'x' USING v LIMIT 3), b AS (QUERY 'y' PREFETCH (A) LIMIT 2) QUERY FUSION DBSF FROM c PREFETCH (a WHERE x = 1 SCORE THRESHOLD 0.5 LOOKUP FROM d VECTOR w, QUERY 'z' LIMIT 4) LIMIT 1",
    "QUERY FORMULA $score * (1 - x) / y [DEFAULT = 2] + ABS(-z) DEFAULTS (x = 1) FROM c", "QUERY FORMULA CASE WHEN a = 1 AND NOT b IS NULL THEN 1.0 ELSE 2.0 END FROM c",
    "QUERY FORMULA EXP_DECAY(x, target = 3, scale = 2, decay = 0.3) + GEO_DISTANCE(1.0, 2.0, p) + MATCH(a, 'b') + datetime('2020-01-01') FROM c",
    "QUERY RELEVANCE FEEDBACK TARGET 'x' FEEDBACK ((POINT 1, 0.5), ('y', -1)) STRATEGY NAIVE (a = 1, b = 2, c = 3) FROM c", "QUERY MMR 'x' DIVERSITY 0.3 CANDIDATES 9 FROM c",
    "QUERY HYBRID TEXT 'x' DENSE d SPARSE s FUSION RRF FROM c PARAMS (rrf_k = 3, rrf_weights = [1, 2])", "QUERY TEXT 'x' FROM c USING HYBRID SPARSE s",
    "QUERY CROSS RERANK 'x' MODEL 'm' ON FIELD body FROM c PREFETCH (QUERY 'x')", "QUERY RERANK VECTOR [1] MODEL 'm' FROM c USING v PREFETCH (QUERY 'x' LIMIT 2)",
    "QUERY 'x' FROM c WHERE a = 1 AND (b != 'x' OR NOT c IN (1, 2.5, null)) AND d NOT IN (true) GROUP BY g SIZE 2 LOOKUP FROM d WITH PAYLOAD INCLUDE (a, b) WITH VECTOR (v) LIMIT 2",
    "QUERY 'x' FROM c PARAMS (hnsw_ef = 3, exact = true, acorn = true, max_selectivity = 0.4, quantization = {rescore: true}, timeout = 3, consistency = quorum)",
    "SCROLL FROM c WHERE a ≥ 2 AFTER 5 SHARD 'x' WITH VECTOR false LIMIT 3", "COUNT FROM c WHERE a BETWEEN 1 AND 2 WITH (exact = false)",
    "COUNT FROM c WHERE a MATCH 'x' AND b MATCH ANY ('x') AND c MATCH PHRASE 'x y' AND d IS NOT EMPTY AND HAS_VECTOR v AND e VALUES_COUNT >= 0 AND NESTED('f', g = 1)",
    "COUNT FROM c WHERE p GEO_RADIUS {center: {lat: 1, lon: 2}, radius: 3} OR p GEO_POLYGON {exterior: [{lat: 1, lon: 2}, {lat: 2, lon: 2}, {lat: 2, lon: 1}]}",
    "UPSERT INTO c VALUES {id: 1, vector: {v: [1, 2]}, a: [1, {b: null}], t: 'x'}, {id: 'u', vector: [1]} USING HYBRID DENSE MODEL 'm' VECTOR v SPARSE INTO s, MULTI ON FIELD t EMBED t INTO w USING SPARSE MODEL 'm' SHARD 'k'",
    "DELETE FROM c WHERE id IN (1, 2)", "DELETE PAYLOAD a, b FROM c WHERE id = 1", "DELETE VECTOR v FROM c WHERE a > 1 SHARD 'x'", "CLEAR PAYLOAD FROM c WHERE a = 1", "UPDATE c SET PAYLOAD = {a: 1} WHERE b = 2", "UPDATE c SET VECTOR v = [1, 2] WHERE id = 'x'",
    "CREATE COLLECTION c (v VECTOR(3, DOT) WITH HNSW (m = 4) WITH MULTIVECTOR (comparator = 'max_sim'), s SPARSE WITH SPARSE (modifier = 'idf')) WITH PARAMS (shard_number = 2)", "CREATE COLLECTION c HYBRID RERANK", "CREATE COLLECTION c USING DENSE MODEL 'm'",
    "ALTER COLLECTION c WITH QUANTIZATION (disabled = true)", "DROP COLLECTION c", "CREATE INDEX ON COLLECTION c FOR a.b TYPE text WITH (lowercase = true, tokenizer = 'word')", "DROP INDEX ON COLLECTION c FOR a",
    "CREATE SHARD KEY 'k' ON COLLECTION c WITH (shards_number = 2)", "DROP SHARD KEY 'k' ON COLLECTION c", "SHOW COLLECTIONS", "SHOW COLLECTION c", "SHOW SHARD KEYS ON COLLECTION c",
]

INVALID = {
    "LEX-CHAR": ["QUERY ^"], "LEX-NUMBER": ["COUNT FROM c WHERE a = 1.", "COUNT FROM c WHERE a = -.5", "COUNT FROM c WHERE a = 1e"], "LEX-STRING": ["QUERY 'a FROM c"], "PARSE-ESCAPE": ["QUERY 'a\\q' FROM c"],
    "PARSE-STATEMENT": ["SELECT * FROM c", "INSERT INTO c"], "PARSE-EMPTY-STATEMENT": [";", "SHOW COLLECTIONS;;"], "PARSE-EXPECTED": ["COUNT FROM c WHERE (a = 1", "CREATE COLLECTION c VECTORS (a VECTOR(1, DOT)) WITH X (a = 1)"][:1],
    "PARSE-QUERY-INPUT": ["QUERY 42 FROM c"], "PARSE-CLAUSE-ORDER": ["QUERY 'a' FROM c LIMIT 1 WHERE a = 1", "QUERY 'a' FROM c LIMIT 1 LIMIT 2", "COUNT FROM c SHARD 'a' SHARD 'b'"],
    "PARSE-VECTOR-KIND": ["QUERY 'a' FROM c USING v AS HYBRID"], "PARSE-DUPLICATE-CTE": ["WITH a AS (QUERY 'x'), A AS (QUERY 'y') QUERY FUSION RRF FROM c PREFETCH (a)"], "PARSE-DUPLICATE-KEY": ["UPSERT INTO c VALUES {id: 1, ID: 2}"],
    "PARSE-POSITIVE-INTEGER": ["QUERY 'a' FROM c LIMIT 0", "QUERY MMR 'x' DIVERSITY 0.1 CANDIDATES 0 FROM c"], "PARSE-NONNEGATIVE-INTEGER": ["QUERY 'a' FROM c OFFSET -1"], "PARSE-SYNTAX": ["CREATE COLLECTION c (v VECTOR(0, DOT))", "QUERY FORMULA foo(1) FROM c"],
    "PARSE-COMPARISON": ["COUNT FROM c WHERE a VALUES_COUNT 3"], "PARSE-CONTEXT": ["QUERY CONTEXT () FROM c"], "PARSE-COUNT-CONFIG": ["COUNT FROM c WITH (exact = 5)", "COUNT FROM c WITH (other = true)"], "PARSE-CROSS-RERANK": ["QUERY CROSS RERANK POINT 1 MODEL 'm' FROM c"],
    "PARSE-EMBED": ["UPSERT INTO c VALUES {id: 1} EMBED a INTO b USING banana"], "PARSE-EMBEDDING": ["UPSERT INTO c VALUES {id: 1} USING HYBRID DENSE MODEL 'a' MODEL 'b'"], "PARSE-FEEDBACK-STRATEGY": ["QUERY RELEVANCE FEEDBACK TARGET 'x' FEEDBACK (('y', 1)) STRATEGY NAIVE (a = 1, c = 1, b = 2) FROM c"],
    "PARSE-FILTER": ["COUNT FROM c WHERE a IS 3", "COUNT FROM c WHERE a LIKE 'b'"], "PARSE-IN": ["COUNT FROM c WHERE a IN ()"], "PARSE-MATCH-ANY": ["COUNT FROM c WHERE a MATCH ANY ()"], "PARSE-INDEX-TYPE": ["CREATE INDEX ON COLLECTION c FOR a TYPE 'text'"], "PARSE-IDENTIFIER": ["DROP COLLECTION 5"],
    "PARSE-NUMBER": ["QUERY MMR 'x' DIVERSITY y CANDIDATES 1 FROM c"], "PARSE-OBJECT-KEY": ["UPSERT INTO c VALUES {5: 1}"], "PARSE-PAYLOAD-SELECTOR": ["QUERY 'a' FROM c WITH PAYLOAD 5"], "PARSE-POINT-ID": ["QUERY POINT -1 FROM c"], "PARSE-POINT-IDS": ["QUERY POINTS () FROM c"], "PARSE-PREFETCH": ["QUERY FUSION RRF FROM c PREFETCH ()"],
    "PARSE-RERANK": ["QUERY RERANK 'x' MODEL 'm' FROM c USING v PREFETCH (QUERY 'x')"], "PARSE-SAMPLE": ["QUERY SAMPLE ALL FROM c"], "PARSE-SELECTOR": ["QUERY 'a' FROM c WITH PAYLOAD INCLUDE ()"], "PARSE-SEPARATOR": ["SHOW COLLECTIONS SHOW COLLECTIONS"], "PARSE-SHARD-KEY-CONFIG": ["CREATE SHARD KEY 'a' ON COLLECTION c WITH (shards_number = 0)"],
    "PARSE-STATEMENT-LIMIT": ["SHOW COLLECTIONS;" * 257], "PARSE-TRAILING": ["SHOW COLLECTIONS 5"], "PARSE-UPDATE": ["UPDATE c SET a = 1 WHERE id = 1"], "PARSE-VALUE": ["COUNT FROM c WHERE a = )"], "PARSE-FIELD": ["COUNT FROM c WHERE 5 = 5"],
    "VALIDATION-FROM": ["QUERY 'a'"], "VALIDATION-PREFETCH-CTE": ["QUERY FUSION RRF FROM c PREFETCH (a)"], "VALIDATION-FUSION-PREFETCH": ["QUERY FUSION RRF FROM c"], "VALIDATION-RERANK-PREFETCH": ["QUERY RERANK TEXT 'x' MODEL 'm' FROM c USING v"], "VALIDATION-CROSS-RERANK-PREFETCH": ["QUERY CROSS RERANK 'x' MODEL 'm' FROM c"],
    "VALIDATION-POINTS-CLAUSE": ["QUERY POINTS (1) FROM c LIMIT 2"], "VALIDATION-UPSERT-ID": ["UPSERT INTO c VALUES {a: 1}", "UPSERT INTO c VALUES {id: -1}"], "VALIDATION-MMR": ["QUERY MMR 'x' DIVERSITY 1.5 CANDIDATES 1 FROM c"], "VALIDATION-HYBRID": ["QUERY POINT 1 FROM c USING HYBRID", "QUERY HYBRID 'x' FROM c USING v"],
    "VALIDATION-ID-PREDICATE": ["COUNT FROM c WHERE id > 3"], "VALIDATION-POINT-ID": ["COUNT FROM c WHERE id = 1.5"], "VALIDATION-ACORN-SELECTIVITY": ["QUERY 'a' FROM c PARAMS (max_selectivity = 0.1)"], "VALIDATION-CONFIG": ["CREATE COLLECTION c WITH HNSW (x = 1)", "CREATE COLLECTION c WITH QUANTIZATION (type = 'x')", "CREATE COLLECTION c WITH PARAMS (read_fan_out_factor = 2)"],
    "VALIDATION-CONSISTENCY": ["QUERY 'a' FROM c PARAMS (consistency = some)"], "VALIDATION-CREATE-MODEL": ["CREATE COLLECTION c HYBRID MODEL 'm'"], "VALIDATION-FUSION": ["QUERY FUSION SUM FROM c"], "VALIDATION-GEO": ["COUNT FROM c WHERE p GEO_RADIUS {center: {lat: 91, lon: 0}, radius: 1}", "COUNT FROM c WHERE p GEO_RADIUS {center: {lat: 1, lon: 0}, radius: 0}", "COUNT FROM c WHERE p GEO_POLYGON {exterior: [{lat: 1, lon: 0}]}"],
    "VALIDATION-LIMIT-OVERFLOW": ["QUERY 'a' FROM c LIMIT 18446744073709551615 OFFSET 2"], "VALIDATION-PREFETCH": ["QUERY SAMPLE RANDOM FROM c PREFETCH (QUERY 'x')"], "VALIDATION-USING": ["QUERY ORDER BY a FROM c USING v"], "VALIDATION-RECOMMEND-STRATEGY": ["QUERY RECOMMEND POSITIVE (1) STRATEGY best FROM c"], "VALIDATION-RERANK-USING": ["QUERY RERANK TEXT 'x' MODEL 'm' FROM c PREFETCH (QUERY 'x')"],
    "VALIDATION-SCORE": ["QUERY 'a' FROM c SCORE THRESHOLD x"], "VALIDATION-SEARCH-PARAM": ["QUERY 'a' FROM c PARAMS (k = 3)"], "VALIDATION-VECTOR": ["QUERY VECTOR [] FROM c", "QUERY VECTOR {indices: [1], values: [1, 2]} FROM c", "QUERY VECTOR [[1], [1, 2]] FROM c"],
    "PLAN-VECTOR-KIND": ["QUERY VECTOR [1] FROM c USING v AS SPARSE", "QUERY DISCOVER TARGET VECTOR [1] CONTEXT (POSITIVE VECTOR {indices: [1], values: [1]} NEGATIVE POINT 1) FROM c"], "PLAN-RRF-PARAMS": ["QUERY 'a' FROM c PARAMS (rrf_k = 3)"], "PLAN-RRF-WEIGHTS": ["QUERY FUSION RRF FROM c PREFETCH (QUERY 'x') PARAMS (rrf_weights = [1, 2])"],
}


@pytest.mark.parametrize("source", VALID)
def test_valid(source):
    (s,) = parse(source)
    assert to_json(s)["node"] == type(s).__name__
    assert is_valid(source.lower().replace("'id'", "'ID'") if "'" not in source else source)


@pytest.mark.parametrize("code, source", [(c, s) for c, ss in INVALID.items() for s in ss])
def test_invalid(code, source):
    with pytest.raises(SeekError) as e:
        parse(source)
    assert e.value.code == code and not is_valid(source)


def test_strings_and_names():
    values = [t.value for t in tokenize("'it''s' \"a\\n\" r'\\n' `x'y` '''a'b''' '' '''' a.b c[].d $score -- gone\n ≠") if t.kind in ("string", "name")]
    assert values == ["it's", "a\n", "\\n", "x'y", "a'b", "", "'", "a.b", "c[].d", "$score"]
    with pytest.raises(SeekError) as e:
        parse("QUERY 'é' FROM c LIMIT 0")
    assert e.value.span == (24, 25) and e.value.kind == "parse"


def test_shapes():
    q = parse_one("QUERY 'x' FROM c WHERE a = 1 OR b = 2 AND NOT c != 3")
    assert q.where == n.Or((n.Compare("a", "=", 1), n.And((n.Compare("b", "=", 2), n.Not(n.Not(n.Compare("c", "=", 3)))))))
    f = parse_one("QUERY FORMULA 1 + 2 * -x - 3 FROM c").expr.expr
    assert f == n.Binary("-", n.Binary("+", n.Number(1), n.Binary("*", n.Number(2), n.Call("neg", (n.Variable("x"),)))), n.Number(3))
    assert isinstance(parse_one("QUERY 'x' FROM c USING HYBRID").expr, n.Hybrid)


def test_injection():
    q = inject_filter(parse_one("WITH a AS (QUERY 'x' WHERE z = 1 LIMIT 3) QUERY FUSION RRF FROM c PREFETCH (a, a WHERE y = 2) WHERE w = 3"), "t", "=", "k")
    own = n.Compare("t", "=", "k")
    assert q.where == n.And((n.Compare("w", "=", 3), own)) and q.ctes[0][1].where == n.And((n.Compare("z", "=", 1), own))
    assert q.prefetch[0].where is None and q.prefetch[1].where == n.And((n.Compare("y", "=", 2), own))
    u = inject_filter(parse_one("UPSERT INTO c VALUES {id: 1, t: 'old'}"), "t", "=", "k")
    assert dict(u.points[0].payload) == {"t": "k"}
    for source in ("SHOW COLLECTIONS", "DROP COLLECTION c"):
        with pytest.raises(SeekError):
            inject_filter(parse_one(source), "t", "=", 1)
    assert get_shard(set_shard(q, "s")) == "s" and set_shard(q, "s").ctes[0][1].shard == "s"


def test_sparse_text():
    assert tokens("Hello, World! 123 TEST_token") == ["hello", "world", "123", "test_token"]
    assert tokens("a b c d go rs") == ["c", "go", "rs"]
    assert tokens("B-cell CD19-negative Привет") == ["cell", "cd19", "negative", "привет"]
    indices, values = query_vector("hello hello world")
    assert indices == sorted(indices) and dict(zip(indices, values))[token_index("hello")] == pytest.approx(1 + 0.6931471805599453)
    indices, values = document_vector("hello hello world")
    assert dict(zip(indices, values))[token_index("world")] == pytest.approx(2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 256)))


@pytest.mark.parametrize("body", [
    {"query": [0.1, 0.2], "using": "v", "limit": 3, "filter": {"must": [{"key": "a", "match": {"value": "x"}}, {"key": "b", "range": {"gt": 1, "lte": 5.5}}], "should": [{"has_id": [1, "u"]}, {"is_empty": {"key": "c"}}], "must_not": [{"key": "d", "match": {"any": [1, 2]}}]}},
    {"query": {"fusion": "dbsf"}, "prefetch": [{"query": {"indices": [1], "values": [0.5]}, "using": "s", "limit": 9}, {"query": 7, "using": "v", "score_threshold": 0.5}], "with_payload": {"exclude": ["x"]}, "with_vector": ["v"]},
    {"query": {"formula": {"sum": ["$score", {"mult": [2, {"exp_decay": {"x": "age", "scale": 3}}]}, {"div": {"left": 1, "right": "n", "by_zero_default": 0.5}}, {"key": "t", "match": {"value": "a"}}]}, "defaults": {"age": 1}}, "prefetch": {"query": 3, "using": "v"}},
    {"query": {"nearest": [1, 2], "mmr": {"diversity": 0.3, "candidates_limit": 20}}, "using": "v", "group_by": "g", "group_size": 2, "with_lookup": "other"},
    {"query": {"discover": {"target": 1, "context": [{"positive": 2, "negative": 3}]}}, "using": "v"}, {"query": {"recommend": {"positive": [1], "negative": [2], "strategy": "best_score"}}, "using": "v"},
    {"query": {"order_by": {"key": "a", "direction": "desc"}}, "params": {"exact": True}}, {"query": {"sample": "random"}}, {"vector": {"name": "v", "vector": [1, 2]}, "limit": 2}, {"positive": [1], "negative": [], "using": "v"}, {"target": 1, "context": [{"positive": 2, "negative": 3}]},
    {"filter": {"must": [{"key": "p", "geo_radius": {"center": {"lat": 1, "lon": 2}, "radius": 5}}, {"nested": {"key": "r", "filter": {"must": [{"key": "s", "match": {"text": "x y"}}]}}}]}, "limit": 4, "offset": 5}, {"ids": [1, "a"], "with_payload": True},
    {"points": [{"id": 1, "vector": {"v": [1, 2]}, "payload": {"a": [1, None, {"b": "it's"}]}}]}, {"points": [1, 2]}, {"payload": {"a": 1}, "points": [1]}, {"keys": ["a"], "filter": {"must": [{"key": "a", "values_count": {"gte": 2}}]}},
    {"vectors": {"size": 3, "distance": "Cosine"}, "sparse_vectors": {"s": {"modifier": "idf"}}, "hnsw_config": {"m": 4}}, {"field_name": "a", "field_schema": "keyword"},
])
def test_converted_requests_parse(body):
    from sparkseek.sources.convert import convert

    assert len(parse(convert(body, "my docs"))) == 1
