"""The engine on small collections, and the registered queries against DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkseek import queries as registered
from sparkseek.engine import Engine
from sparkseek.errors import SeekError
from sparkseek.parser import parse_one
from sparkseek.sources.catalog import VectorDef
from sparkseek.sources.dump import dump, statements

SF = "/root/testdata/sf0.001"
SCRIPT = """
CREATE COLLECTION d (v VECTOR(3, COSINE), s SPARSE);
CREATE SHARD KEY 'a' ON COLLECTION d;
UPSERT INTO d VALUES
  {id: 1, text: 'red fox runs', n: 5, tags: ['a', 'b'], loc: {lat: 10.0, lon: 20.0}, vector: {v: [1, 0, 0], s: {indices: [1, 2], values: [0.5, 1.0]}}},
  {id: 'x', text: 'blue cat', n: 7.5, tags: [], rev: [{r: 5, by: 'k'}, {r: 1, by: 'z'}], vector: {v: [0, 1, 0]}},
  {id: 18446744073709551615, n: null, vector: {v: [0.6, 0.8, 0]}} SHARD 'a';
UPDATE d SET PAYLOAD = {n: 9, q: true} WHERE id = 1;
DELETE PAYLOAD tags FROM d WHERE id = 'x';
CREATE INDEX ON COLLECTION d FOR text TYPE text
"""
BIG = "18446744073709551615"
COUNTS = {
    "n > 6": 2, "NOT n > 6": 1, "n != 9": 2, "n IS NULL": 1, "n IS NOT NULL": 2, "tags IS EMPTY": 2, "tags = 'b'": 1, "tags IN ('x', 'a')": 1, "NESTED('rev', r > 4 AND by = 'k')": 1, "NESTED('rev', r > 4 AND by = 'z')": 0,
    "rev[].by = 'z'": 1, "text MATCH 'FOX red'": 1, "text MATCH PHRASE 'fox red'": 0, "loc GEO_RADIUS {center: {lat: 10.0, lon: 20.1}, radius: 20000.0}": 1, "q = true": 1, "HAS_VECTOR s": 1, "tags VALUES_COUNT = 2": 1,
    f"id = {BIG}": 1, "id IN (1, 'x')": 2, "id != 'x'": 2, "missing = 1": 0, "NOT missing = 1": 3, "text = 5": 0, "loc.lat BETWEEN 9 AND 11": 1,
}


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    report = e.execute(SCRIPT)
    assert report.ok, report.results[-1].error
    return e


def ids(rows):
    return [r["id"] for r in rows.collect()]


@pytest.mark.parametrize("where", COUNTS)
def test_filters_on_variants(engine, where):
    assert engine.query(f"COUNT FROM d WHERE {where}").first()[0] == COUNTS[where]


def test_reads(engine):
    assert ids(engine.query("QUERY VECTOR [1, 1, 0] FROM d USING v")) == [BIG, "1", "x"]
    assert ids(engine.query("QUERY POINT 1 FROM d USING v")) == [BIG, "x"]
    assert ids(engine.query("QUERY VECTOR {indices: [2, 9], values: [1.0, 1.0]} FROM d")) == ["1"]
    assert ids(engine.query("SCROLL FROM d AFTER 2 LIMIT 5")) == [BIG, "x"]
    assert ids(engine.query("QUERY ORDER BY n DESC FROM d")) == ["1", "x"]
    assert ids(engine.query("QUERY MMR VECTOR [1, 0.2, 0] DIVERSITY 0.5 CANDIDATES 3 FROM d USING v")) == ["1", "x", BIG]
    assert ids(engine.query("QUERY CROSS RERANK 'blue cat' MODEL 'm' FROM d PREFETCH (QUERY VECTOR [1, 1, 0] USING v)")) == ["x", "1"]
    assert ids(engine.query("QUERY POINTS (1, 'x', 5) FROM d WITH VECTOR")) == ["1", "x"]
    from sparkseek.operators.points import next_cursor

    assert next_cursor(engine.planner, parse_one("SCROLL FROM d LIMIT 2")) == "x" and next_cursor(engine.planner, parse_one("SCROLL FROM d LIMIT 3")) is None
    assert "statement: Count" in engine.explain("COUNT FROM d WHERE id = 1") and engine.compile("SHOW COLLECTIONS")[0]["stmt_type"] == "show_collections"


@pytest.mark.parametrize("code, statement", {
    "COLLECTION": "COUNT FROM nothing", "MISSING-USING": "QUERY TEXT 'x' FROM d", "UNKNOWN-VECTOR": "QUERY POINT 1 FROM d USING w", "VECTOR-KIND": "QUERY TEXT 'x' FROM d USING v AS SPARSE", "PLAN-PREFETCH-GROUP": "QUERY POINT 1 FROM d USING v PREFETCH (QUERY POINT 1 USING v GROUP BY n)",
    "PLAN-UNSUPPORTED-PREFETCH": "QUERY POINT 1 FROM d USING v PREFETCH (QUERY POINTS (1))", "PLAN-COLLECTION": "QUERY POINT 1 FROM d USING v PREFETCH (QUERY POINT 1 FROM other USING v)", "VALIDATION-VECTOR": "QUERY VECTOR [1, 2] FROM d USING v", "POINT": "QUERY POINT 77 FROM d USING v",
}.items())
def test_errors(engine, code, statement):
    with pytest.raises(SeekError) as e:
        engine.query(statement)
    assert e.value.code == code


def test_scripts_and_changes(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(20)], "k long, name string, x double"), "k")
    report = e.execute("DELETE FROM t WHERE id = 3; UPSERT INTO t VALUES {id: 4, name: 'new'}; UPSERT INTO t VALUES {id: 50, other: 1}; CLEAR PAYLOAD FROM t WHERE x > 17.0; COUNT FROM t", "continue")
    assert [r.ok for r in report.results] == [True, True, False, True, True] and not report.ok
    assert report.results[-1].data.first()[0] == 19
    rows = {r["id"]: (r["name"], r["x"]) for r in e.query("SCROLL FROM t LIMIT 100").collect()}
    assert rows[4] == ("new", None) and rows[18] == (None, None) and rows[5] == ("n5", 5.0) and 3 not in rows
    assert len(e.execute("COUNT FROM nothing; COUNT FROM t").results) == 1
    assert e.execute_async("COUNT FROM t").result().ok and len(e.collect("COUNT FROM t PARAMS (timeout = 60)".split(" PARAMS")[0])) == 1
    assert len(e.collect("QUERY ORDER BY x FROM t PARAMS (timeout = 60) LIMIT 2")) == 2


def test_dump_round_trip(engine, spark, tmp_path):
    script = "\n".join(statements(engine.collection("d")))
    again = Engine(spark)
    assert again.execute(script).ok
    assert "\n".join(statements(again.collection("d"))) == script
    assert dump(engine.collection("d"), str(tmp_path / "d.txt")) == 3


def test_texts_are_embedded(spark):
    e = Engine(spark)
    assert e.execute("UPSERT INTO auto VALUES {id: 1, text: 'hello big world'}, {id: 2, text: 'other thing'}").ok
    assert ids(e.query("QUERY HYBRID 'big world' FROM auto LIMIT 1")) == ["1"]
    assert e.execute("CREATE COLLECTION r HYBRID RERANK; UPSERT INTO r VALUES {id: 1, body: 'red fox'}, {id: 2, body: 'blue cat'} USING HYBRID, MULTI INTO colbert").ok
    assert ids(e.query("QUERY RERANK TEXT 'cat' MODEL 'm' FROM r USING colbert PREFETCH (QUERY TEXT 'fox cat' USING dense LIMIT 5) LIMIT 1")) == ["2"]


def test_plans(spark):
    e = registered.engine(spark, SF)
    near = e.explain("QUERY POINT 7 FROM embeddings USING embedding WHERE label = 3 LIMIT 10")
    assert "TakeOrderedAndProject" in near and "EqualTo(label,3)" in near
    assert "BroadcastHashJoin LeftSemi" in e.explain("QUERY POINT 42 FROM embeddings USING embedding PREFETCH (QUERY POINT 7 USING embedding LIMIT 50)", "simple").replace("  ", " ") or "LeftSemi" in e.explain("QUERY POINT 42 FROM embeddings USING embedding PREFETCH (QUERY POINT 7 USING embedding LIMIT 50)")
    assert "PushedFilters: [In(o_orderkey, [1,2])]" in e.explain("COUNT FROM orders WHERE id IN (1, 2)")
    assert "WindowGroupLimit" in e.explain("QUERY POINT 7 FROM embeddings USING embedding GROUP BY label")
    scored = e.explain("QUERY POINT 7 FROM embeddings USING embedding SCORE THRESHOLD 0.1 GROUP BY label SIZE 2 LIMIT 3", "simple")
    assert scored.count("FileScan parquet") == 1 and scored.count("zip_with") == 1, scored  # one scan, one scoring
    near = e.explain("QUERY POINT 7 FROM embeddings USING embedding SCORE THRESHOLD 0.1", "simple")
    assert near.count("zip_with") == 1 and "TakeOrderedAndProject" in near, near
    scan = e.explain("COUNT FROM lineitem WHERE l_quantity > 25")
    assert "GreaterThan(l_quantity,25)" in scan.replace(".0", "") and "l_comment" not in scan


NAMES = ["nearest_euclid", "nearest_filtered", "multi_maxsim", "recommend_best", "discover", "fusion_dbsf", "prefetch_override", "cte_chain", "cross_rerank", "sparse_idf", "group_multivalue", "group_lookup", "formula_case", "formula_geo_distance", "filter_ne", "filter_path", "filter_geo_polygon", "upsert_then_count", "upsert_large", "show_collections", "show_collection", "show_shard_keys", "upsert_embedded", "upsert_specified", "shard_scroll", "errors", "compiled_routes", "dump_restored", "converted_request", "scroll_pages", "image_nearest", "cross_rerank_two", "upsert_after_restart", "mmr", "hybrid_rrf", "sparse_bm25", "update_vector", "inject_filter_query", "flagship"]


@pytest.mark.parametrize("name", NAMES)
def test_registered_queries(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registered.ORACLE[name])
    columns = [d[0] for d in found.description]
    df = registered.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    plain = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())


def test_dump_by_the_executors(engine, spark, tmp_path):
    from sparkseek.sources.dump import dump_folder, restore

    folder = str(tmp_path / "d")
    dump_folder(engine.collection("d"), folder, 2)
    again = Engine(spark)
    restore(again, folder)
    assert "\n".join(statements(again.collection("d"))) == "\n".join(statements(engine.collection("d")))
    twice = spark.createDataFrame([(1, "a\u2028b\n", [1.0, 2.0]), (1, "a\u2028b\n", [1.0, 2.0]), (2, None, None)], "k long, x string, v array<float>")
    other = Engine(spark)
    other.register("t", twice, "k", {"v": VectorDef(size=2)})
    dump_folder(other.collection("t"), str(tmp_path / "t"))
    again = Engine(spark)
    restore(again, str(tmp_path / "t"))
    assert [(r["id"], r["payload"].toPython()) for r in again.query("SCROLL FROM t LIMIT 5").collect()] == [("1", {"x": "a\u2028b\n"}), ("2", {})]
    with pytest.raises(SeekError):
        restore(Engine(spark), str(tmp_path / "none"))


def test_the_dump_query_keeps_the_script_off_the_driver(spark, monkeypatch):
    from sparkseek import parser

    longest, parse = [0], parser.parse
    monkeypatch.setattr("sparkseek.engine.parse", lambda source: (longest.append(len(source)), parse(source))[1])
    assert registered.QUERIES["dump_restored"](spark, SF).count() == 5 and max(longest) < 10_000
