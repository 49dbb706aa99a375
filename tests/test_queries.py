"""Every registered query against its SQL on the smallest tables; streams; sources; the entry without the training-data subpackage."""

import ast
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.queries import registry
from tessera.sources import resp, snapshot
from tessera.streaming import cdc, windows

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def cell(x):
    if x is None or x != x:
        return "-"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.collect()
        return
    want = duck.sql(registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda rs: sorted(tuple(map(cell, r)) for r in rs)
    picked = ", ".join(f'"{c}"' for c in cols)
    assert rows(got.select(*[F.col(f"`{c}`") for c in cols]).collect()) == rows(want.select(picked).fetchall())


def test_no_helper_of_the_queries_is_defined_twice():
    """A second function of a name would stand in for the first wherever a query calls it."""
    folder = os.path.join(ROOT, "tessera", "queries")
    for f in os.listdir(folder):
        if f.endswith(".py"):
            with open(os.path.join(folder, f)) as source:
                names = Counter(n.name for n in ast.parse(source.read()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
            assert not [(f, n) for n, c in names.items() if c > 1]


@needs_tables
def test_cells_reach_nine_tenths_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.lit("main").alias("index"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = vectors.CellIndex(v, 8)
    queries = v.where("id % 50 = 0").orderBy("id").collect()
    hits = sum(len({r["id"] for r in index.search(q["vec"], 10, 6).collect()} & {r["id"] for r in vectors.knn(v, q["vec"], 10).collect()}) for q in queries)
    assert hits >= 0.9 * 10 * len(queries)


def test_blocks_of_queries_give_the_same_neighbours(spark, monkeypatch):
    v = spark.range(60).select(F.lit("i").alias("index"), "id", F.array(*[F.sin(F.col("id") * d).cast("float") for d in range(1, 5)]).alias("vec"))
    q = v.select(F.col("id").alias("qid"), "vec")
    whole = sorted(map(tuple, vectors.knn_join(v, q, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, vectors.knn_join(v, q, 3).collect())) == whole


@needs_tables
def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(live, "ts", "event_type", "1 day", "60 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((str(r[0]), r[1], r[2]) for r in rows)
    assert key(spark.table("counts").collect()) == key(windows.windowed_counts(e, "ts", "event_type", "1 day", "60 days").collect())


def test_blocking_pops_keep_their_order(spark, tmp_path):
    rows = [("q", "push", 1, "v1"), ("q", "push", 2, "v2"), ("q", "pop", 3, "w1"), ("z", "pop", 1, "w2"), ("q", "pop", 4, "w3"), ("q", "pop", 5, "w4"), ("z", "push", 2, "v3")]
    spark.createDataFrame(rows, "key string, kind string, seq long, value string").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("key string, kind string, seq long, value string").parquet(str(tmp_path / "in"))
    q = windows.matched_pops(live).writeStream.format("memory").queryName("pops").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("pops").collect())) == [("q", "w1", "v1"), ("q", "w3", "v2"), ("z", "w2", "v3")]


def test_change_log_stream_and_replay(spark, tmp_path):
    log = spark.createDataFrame([(0, 1, "SET", "a", "1"), (1, 2, "SET", "b", "2"), (2, 3, "DEL", "a", None), (3, 4, "SET", "c", "3")], cdc.SCHEMA)
    snapshot.append_log(log, str(tmp_path / "log"))
    assert sorted(map(tuple, snapshot.replay(snapshot.read_log(spark, str(tmp_path / "log"))).collect())) == [("b", "2"), ("c", "3")]
    log.write.parquet(str(tmp_path / "flat"))
    q = cdc.matching(cdc.stream(spark, str(tmp_path / "flat")), "?").writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("log").count() == 4
    flushed = log.unionByName(spark.createDataFrame([(4, 5, "FLUSHDB", None, None), (5, 6, "SET", "d", "4")], cdc.SCHEMA))
    assert [tuple(r) for r in snapshot.replay(flushed).collect()] == [("d", "4")]


def test_frames_round_trip(spark, tmp_path):
    values = [None, 5, "text", b"\x00\r\n", [1, [b"x", None]], -7]
    for v in values:
        raw = resp.serialize(v)
        got, end = resp.parse(raw)
        assert end == len(raw) and resp.serialize(got) == raw
        assert all(resp.parse(raw[:i]) is None for i in range(len(raw)))
    assert resp.parse(resp.serialize({"a": 1.5, "b": True}, resp3=True))[0] == {b"a": 1.5, b"b": True}
    (tmp_path / "conn").write_bytes(resp.serialize(["SET", "k", "v"]) + resp.serialize(["GET", "k"]))
    got = resp.commands(spark.read.format("binaryFile").load(str(tmp_path / "conn"))).orderBy("pos").collect()
    assert [r["args"] for r in got] == [["SET", "k", "v"], ["GET", "k"]]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": [2]}\n')
    got = snapshot.read_documents(spark, str(tmp_path / "x.json"), "id")
    assert [r["doc_id"] for r in got.orderBy("doc_seq").collect()] == ["a", "b"]


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("tessera", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tessera" / "llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
