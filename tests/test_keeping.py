"""What outlives an engine, large statements, limits of time, and the functions for scripts."""

from __future__ import annotations

import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import sparkseek
from sparkseek.__main__ import main
from sparkseek.embed import HashingEmbedder
from sparkseek.engine import Engine
from sparkseek.errors import SeekError
from sparkseek.operators import fuse
from sparkseek.sources.catalog import VectorDef
from sparkseek.sources.convert import convert_request


def values(engine, name="s"):
    return {r["id"]: r["x"] for r in engine.query(f"SCROLL FROM {name} LIMIT 1000").collect()}


def test_collections_are_there_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    e = Engine(spark, path=path)
    script = "CREATE COLLECTION d (v VECTOR(2, COSINE)) WITH HNSW (m = 8); CREATE INDEX ON COLLECTION d FOR a TYPE keyword; CREATE SHARD KEY 'k' ON COLLECTION d; CREATE COLLECTION gone (v VECTOR(2, DOT)); UPSERT INTO d VALUES {id: 1, a: 'x', vector: {v: [1, 0]}}, {id: 'y', vector: {v: [0, 1]}}; DROP COLLECTION gone"
    report = e.execute(script)
    assert report.ok, report.results[-1].error
    again = Engine(spark, path=path)
    assert set(again.catalog.collections) == {"d"} and again.collection("d").indexes == {"a": {"type": "keyword"}}
    assert again.collection("d").config == e.collection("d").config and list(again.collection("d").shard_keys) == ["k"]
    assert [r["id"] for r in again.query("QUERY VECTOR [1, 0.1] FROM d USING v").collect()] == ["1", "y"]
    assert again.execute("DELETE FROM d WHERE id = 1; UPSERT INTO d VALUES {id: 2, a: 'z'}").ok
    assert Engine(spark, path=path).query("COUNT FROM d").first()[0] == 2
    assert again.catalog.vacuum("d") > 0 and again.query("COUNT FROM d").first()[0] == 2


def test_large_statements_and_failures(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(i, 1.0) for i in range(100)], "k long, x double"), "k")
    assert e.execute("UPSERT INTO t VALUES " + ", ".join(f"{{id: {i}, x: 2.0}}" for i in range(50, 3_000))).ok
    assert e.query("COUNT FROM t").first()[0] == 3_000 and e.query("COUNT FROM t WHERE x = 1.0").first()[0] == 50
    bad = spark.createDataFrame([(1, "a")], "k long, x string").withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    e.register("bad", bad, "k")
    report = e.execute("DELETE FROM bad WHERE x = 'a'; COUNT FROM t", "continue")
    assert [r.ok for r in report.results] == [False, True] and report.results[0].error.code == "EXECUTION"
    assert not e.execute("UPSERT INTO t VALUES {id: 'text', x: 1.0}").ok


def test_buckets_follow_the_bytes(spark, monkeypatch):
    from sparkseek.sources import catalog

    monkeypatch.setattr(catalog, "BUCKET_BYTES", 500)
    e = Engine(spark)
    e.register("t", spark.range(20).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("x")), "k")
    assert e.execute("DELETE FROM t WHERE id = 3").ok
    few = e.collection("t").buckets
    for part in range(3):
        points = ", ".join(f"{{id: {i}, x: '{i}{'abc' * 40}'}}" for i in range(100 + 2000 * part, 2100 + 2000 * part))
        assert e.execute(f"UPSERT INTO t VALUES {points}").ok
    c = e.collection("t")
    assert c.buckets > few and len(c.manifest) > few and e.query("COUNT FROM t").first()[0] == 6_019


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from sparkseek.streaming.ingest import ingest, merge

    path, source = f"file://{tmp_path}/kept", str(tmp_path / "in")
    e = Engine(spark, path=path)
    e.register("s", spark.createDataFrame([(i, 0) for i in range(5)], "k long, x long"), "k")
    for part in range(3):
        if part:  # the driver is new, the checkpoint and the collection are not
            e = Engine(spark, path=path)
        rows = spark.range(3 + part, 6 + part).select(F.col("id").alias("__id"), F.lit(part + 1).cast("long").alias("x"))
        rows.write.mode("append").parquet(source)
        ingest(e, "s", spark.readStream.schema("__id long, x long").parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
    assert values(Engine(spark, path=path)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 3, 6: 3, 7: 3}
    last = e.collection("s").batches[str(tmp_path / "checkpoint")]
    merge(e, "s", spark.createDataFrame([(0, 99)], "__id long, x long"), batch=(str(tmp_path / "checkpoint"), last))
    assert values(e)[0] == 0  # the batch is known
    merge(e, "s", spark.createDataFrame([(0, 5), (0, 7), (0, 6)], "__id long, x long"), "x")
    assert values(e)[0] == 7
    with pytest.raises(ValueError):
        ingest(Engine(spark), "s", spark.readStream.schema("__id long, x long").parquet(source), str(tmp_path / "other"))


def test_limits_of_time(spark):
    e = Engine(spark)
    slow = spark.range(4, numPartitions=4).select(F.col("id").alias("k"), F.expr("aggregate(sequence(0, 200000000), id, (a, x) -> a + x)").alias("x"))
    e.register("slow", slow, "k")
    for run in (e.query, e.collect):
        with pytest.raises(SeekError, match="more than 1"):
            run("QUERY ORDER BY x FROM slow PARAMS (timeout = 1) LIMIT 2")
    assert not e.execute("QUERY ORDER BY x FROM slow PARAMS (timeout = 1) LIMIT 2").ok
    e.register("fast", spark.range(4).select(F.col("id").alias("k"), F.col("id").alias("x")), "k")
    assert [r["id"] for r in e.query("QUERY ORDER BY x DESC FROM fast PARAMS (timeout = 60) LIMIT 2").collect()] == [3, 2]


def test_pages(spark):
    e = Engine(spark)
    e.register("t", spark.range(5).select(F.col("id").alias("k")), "k")
    seen, after = [], ""
    while after is not None:
        rows, after = e.page(f"SCROLL FROM t{f' AFTER {after}' if after != '' else ''} LIMIT 2")
        seen += [r["id"] for r in rows.collect()]
    assert seen == [0, 1, 2, 3, 4]
    e.register("none", spark.range(0).select(F.col("id").alias("k")), "k")
    assert e.page("SCROLL FROM none LIMIT 2")[1] is None


@pytest.mark.parametrize("distance", ["COSINE", "DOT", "EUCLID", "MANHATTAN"])
def test_mmr_by_brute_force(spark, distance):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    gain = rng.normal(size=40)
    frame = spark.createDataFrame([(i, float(g), [float(v) for v in row]) for i, (g, row) in enumerate(zip(gain, x))], "__id long, g double, v array<double>")
    got = [r["__id"] for r in fuse.mmr(frame, "v", "g", 0.4, distance, 12).orderBy("__rank").collect()]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True) if distance == "COSINE" else x
    like = -np.linalg.norm(x[:, None] - x[None], 2 if distance == "EUCLID" else 1, axis=2) if distance in ("EUCLID", "MANHATTAN") else unit @ unit.T
    order = [int(np.argmax(gain))]
    while len(order) < 12:
        order.append(max((i for i in range(40) if i not in order), key=lambda i: 0.6 * gain[i] - 0.4 * like[i, order].max()))
    assert got == order


def test_sparse_texts_without_vectors(spark):
    """Counting the query's words in the text gives what the encoded vectors give, also once they are stored."""
    texts = ["Der Hund und die Katze", None, "", "c c++ und C", "katze katze hund", "x y z", "ÜBER über Katze-Hund"]
    df = spark.createDataFrame([*enumerate(texts)], "k long, text string")
    for idf in (False, True):
        for encoding in ("bm25", "query"):
            e = Engine(spark)
            e.register("t", df, "k", {"s": VectorDef("sparse", idf=idf, column="text", encoding=encoding)})
            ask = "QUERY TEXT 'katze und c über Hund hund' FROM t USING s WITH PAYLOAD false LIMIT 10"
            assert "ArrowEvalPython" not in e.explain(ask)
            quick = e.query(ask).collect()
            assert {r["id"] for r in quick} == {0, 3, 4, 6}
            assert e.execute("UPSERT INTO t VALUES {id: 100, text: 'nothing'}").ok and e.collection("t").vectors["s"].encoding is None
            e.execute("DELETE FROM t WHERE id = 100")
            assert [(r["id"], pytest.approx(r["score"])) for r in e.query(ask).collect()] == [(r["id"], r["score"]) for r in quick]


def test_embedders(spark):
    e = Engine(spark)
    assert e.execute("CREATE COLLECTION r HYBRID RERANK").ok
    report = e.execute("UPSERT INTO r VALUES {id: 1, body: 'red fox'} USING SPARSE MODEL 'splade' INTO sparse")
    assert not report.ok and report.results[0].error.code == "EMBEDDING-SPARSE-MODEL"

    class Joint(HashingEmbedder):
        calls = 0

        def joint(self, texts, model, size, multi_size):
            Joint.calls += 1
            return super().joint(texts, model, size, multi_size)

        def dense(self, texts, model, size):
            assert sys._getframe(1).f_code.co_name in ("joint", "multi", "<listcomp>")
            return super().dense(texts, model, size)

    e = Engine(spark, Joint())
    assert e.execute("CREATE COLLECTION r HYBRID RERANK").ok
    report = e.execute("UPSERT INTO r VALUES {id: 1, body: 'red fox'}, {id: 2, body: 'blue cat'} USING HYBRID, MULTI INTO colbert")
    assert report.ok, report.results[-1].error
    assert Joint.calls == 1 and e.query("COUNT FROM r WHERE HAS_VECTOR colbert AND HAS_VECTOR dense AND HAS_VECTOR sparse").first()[0] == 2


def test_functions_for_scripts(spark, tmp_path):
    s = sparkseek.statements("COUNT FROM d WHERE a = 1; SHOW COLLECTIONS")
    assert [type(x) for x in s] == [sparkseek.Stmt] * 2
    s[0].inject_filter("b", "=", 2)
    s[0].shard_key = "k"
    assert s[0].shard_key == "k" and json.loads(s[0].to_json()) == json.loads(json.dumps(s[0].to_dict()))
    assert sparkseek.compile_query("QUERY POINT 1 FROM d USING v GROUP BY a")["path"] == "/collections/d/points/query/groups"
    found = {q: sparkseek.compile_query(q) for q in ("DROP INDEX ON COLLECTION docs FOR title", "SHOW SHARD KEYS ON COLLECTION docs", "DROP COLLECTION docs", "SHOW COLLECTION docs", "SHOW COLLECTIONS", "QUERY POINTS (42) FROM docs", "UPSERT INTO docs VALUES {id: 1}", "CLEAR PAYLOAD FROM docs WHERE id = 1")}
    assert [(c["stmt_type"], c["method"], c["path"]) for c in found.values()] == [
        ("drop_index", "DELETE", "/collections/docs/index/title"), ("show_shard_keys", "GET", "/collections/docs/shards"), ("drop_collection", "DELETE", "/collections/docs"), ("show_collection", "GET", "/collections/docs"),
        ("show_collections", "GET", "/collections"), ("points", "POST", "/collections/docs/points"), ("upsert", "PUT", "/collections/docs/points"), ("clear_payload", "POST", "/collections/docs/points/payload/clear"),
    ]
    rerank = sparkseek.compile_query("QUERY CROSS RERANK 'q' MODEL 'm' FROM docs PREFETCH (QUERY TEXT 'q' FROM docs USING dense LIMIT 50)")
    assert rerank["stmt_type"] == "cross_rerank" and rerank["path"] is None
    assert sparkseek.explain("QUERY POINT 1 FROM d LIMIT 3")["limit"] == 3
    client = sparkseek.Client(path=f"file://{tmp_path}/kept", spark=spark)
    made = client.execute(["CREATE COLLECTION d (v VECTOR(2, DOT))", sparkseek.statements("UPSERT INTO d VALUES {id: 1, a: 5, vector: {v: [1, 2]}}")[0], "QUERY VECTOR [1, 1] FROM d WITH PAYLOAD false"])
    assert made["ok"] and made["results"][-1]["rows"] == [{"id": "1", "score": 3.0}]
    assert client.execute_async("COUNT FROM d").result()["results"][0]["rows"] == [{"count": 1}]
    assert "Scan" in client.explain("COUNT FROM d")["plan"] and client.execute("COUNT FROM nothing")["results"][0]["error"]["code"] == "COLLECTION"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = f"file://{tmp_path}/kept"
    assert main(["exec", "CREATE COLLECTION d (v VECTOR(2, DOT)); UPSERT INTO d VALUES {id: 1, a: 'x', vector: {v: [1, 2]}}", "--path", path]) == 0
    capsys.readouterr()
    assert main(["exec", "COUNT FROM d", "--path", path, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["rows"] == [{"count": 1}]
    assert main(["dump", "d", str(tmp_path / "d.txt"), "--path", path]) == 0 and "UPSERT INTO 'd'" in (tmp_path / "d.txt").read_text()
    (tmp_path / "r.json").write_text(json.dumps({"method": "POST", "path": "/collections/d/points/count", "body": {}}))
    capsys.readouterr()
    assert main(["convert", str(tmp_path / "r.json")]) == 0 and capsys.readouterr().out == "COUNT FROM 'd';\n"
    (tmp_path / "s.txt").write_text("SHOW COLLECTIONS")
    assert main(["compile", str(tmp_path / "s.txt")]) == 0 and json.loads(capsys.readouterr().out)[0]["path"] == "/collections"
    assert main(["version"]) == 0 and main(["check", str(tmp_path / "s.txt")]) == 0
    (tmp_path / "s.txt").write_text("SHOW")
    assert main(["check", str(tmp_path / "s.txt")]) == 1


def test_requests():
    point = {"query": 7, "limit": 3}
    assert convert_request({"method": "POST", "path": "/collections/d/points/query", "body": point}) == ["QUERY POINT 7 FROM 'd' LIMIT 3"]
    assert convert_request({"method": "POST", "path": "/collections/d/points/query/batch", "body": {"searches": [point, {"query": 8}]}}) == ["QUERY POINT 7 FROM 'd' LIMIT 3", "QUERY POINT 8 FROM 'd'"]
    assert convert_request({"searches": [{"vector": [1.0, 2.0], "limit": 2}]}, "d") == ["QUERY VECTOR [1.0, 2.0] FROM 'd' LIMIT 2"]
    formula = {"query": {"formula": {"sum": ["$score", 1.0]}}, "prefetch": {"query": [0.1, 0.2], "limit": 5}}
    assert convert_request({"method": "POST", "path": "/collections/d/points/query", "body": formula}) == ["QUERY FORMULA ($score + 1.0) FROM 'd' PREFETCH (QUERY VECTOR [0.1, 0.2] LIMIT 5)"]
    assert convert_request([{"method": "DELETE", "path": "/collections/d"}, {"method": "DELETE", "path": "/collections/d/index/a"}]) == ["DROP COLLECTION 'd'", "DROP INDEX ON COLLECTION 'd' FOR 'a'"]
    assert convert_request({"method": "POST", "path": "/collections/d/points/payload/clear", "body": {"points": [1]}}) == ["CLEAR PAYLOAD FROM 'd' WHERE id IN (1)"]
    for statement in (s for r in (formula, point) for s in convert_request(r, "d")):
        assert sparkseek.is_valid(statement)
    for bad in ({"method": "GET", "path": "/telemetry"}, {"method": "PATCH", "path": "/collections/d/points"}, 5):
        with pytest.raises(SeekError):
            convert_request(bad)


def test_the_rest_works_without_the_training_data_package():
    """In a process where the package and the pipeline can't be found."""
    code = """
import importlib.util as u
real = u.find_spec
u.find_spec = lambda name, *a: None if name.startswith(("sparkseek.llm", "corpus_pipeline")) else real(name, *a)
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("sparkseek.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
from sparkseek import queries
assert set(e.queries()) == set(queries.QUERIES) and set(e.oracle_sql()) == set(queries.ORACLE)
assert not any(m.startswith("sparkseek.llm") for m in sys.modules)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
