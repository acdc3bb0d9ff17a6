"""The stages of the corpus pipeline on planted cases, and the SQL of the queries that have some."""

from __future__ import annotations

import random

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join(rng.choice(["stone", "river", "walks", "night", "sings", "glass", "leaf", "wind"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        text = words(rng, 60)
        docs.append((i, text if good else " ".join(w.upper() + "###" for w in text.split()), "en", f"s{i % 3}", 10))
        labels.append((i, int(good), 0))
    near = docs[1][1].split()
    near[30] = "changed"
    items = [(k, words(rng, 25)) for k in range(4)]
    docs += [(1000, docs[1][1], "en", "s0", 10), (1001, " ".join(near), "en", "s0", 10), (1002, words(rng, 30) + " " + items[2][1] + " " + words(rng, 30), "en", "s1", 10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs


def test_stages(spark, planted):
    import corpus_pipeline as p

    folder, docs = planted
    assert [name for name, _ in p.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "token_tables"]
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = p.good_quality(spark, table, folder)
    assert kept.columns == table.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(ids & {i for i in range(300) if i % 4 == 0}) <= 3 and {1, 1000, 1001} <= ids and len(ids) > 220
    single = p.near_duplicates(spark, table, folder)
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == {d for d, *_ in docs} - {1000, 1001}
    clean = p.without_benchmark(spark, table, folder)
    assert {r["doc_id"] for r in clean.select("doc_id").collect()} == {d for d, *_ in docs} - {1002}
    mixed = p.mixed(spark, table, folder)
    assert mixed.columns == table.columns and abs(mixed.count() - len(docs)) < 70
    last = p.run(spark, folder).collect()
    assert last and {r["doc_id"] for r in last}.isdisjoint({1000, 1001, 1002})


def test_queries_with_sql(spark):
    from sparkseek.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, DATA)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall())), name


CLASH = ("__items", "__share", "__quality", "__digest", "__first", "__rate", "score", "sig", "bucket", "copy", "rate", "n_copies")


def test_stages_on_odd_tables(spark, planted, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, names that the stages use themselves; and no rows."""
    import corpus_pipeline as p

    folder, docs = planted
    rng = random.Random(6)
    odd = [(*d, *("x",) * len(CLASH)) for d in docs[1:40]] + [(None, None, None, None, None, *(None,) * len(CLASH)), (2000, "", "en", None, 0, *("x",) * len(CLASH)), (2001, words(rng, 8000), "en", "s1", 1, *("x",) * len(CLASH))]
    odd += [odd[4], odd[4], (None, words(rng, 40), "en", "s2", 1, *("y",) * len(CLASH))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    table = spark.createDataFrame(odd, schema)
    empty = spark.createDataFrame([], schema)
    for name, stage in p.STAGES:
        out = stage(spark, table, folder)
        rows = out.collect()
        if name == "token_tables":
            assert len(rows) == len(odd)
        else:
            assert out.columns == table.columns and rows
            assert {tuple(r) for r in rows} <= set(map(tuple, odd))
        if name == "near_duplicates":
            assert len(rows) == len(odd) - 2 and len(set(map(tuple, rows))) == len(rows)  # the row that stands there three times
        if name == "decontaminate":
            assert len(rows) == len(odd)
        assert stage(spark, empty, folder).count() == 0, name


def test_near_duplicates_by_row(spark, planted):
    """Rows that share an id, or have none, are documents of their own."""
    import corpus_pipeline as p

    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (None, a), (None, b + " end"), (None, words(rng, 50)), (None, ""), (None, None), (3, ""), (4, c), (5, b), (7, None)]
    rows.append(rows[5])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in p.near_duplicates(spark, table, planted[0]).collect())))
    assert got == sorted(map(repr, [(1, a), (1, b), (2, c), rows[5], (None, ""), (None, None), (3, ""), (7, None)]))
