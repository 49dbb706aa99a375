"""Plans and parts that matter on large tables: lookups, numbering, hot keys, snapshots, logs, layouts, many patterns, vectors by cell."""

import io
import contextlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.errors import CommandError
from tessera.operators import bitmaps, docs, geo, hashes, keyspace, lists, order, sets, vectors, zsets
from tessera.sources import snapshot
from tessera.streaming import cdc, pubsub


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def large(monkeypatch):
    """All tables count as large, and ranges are few."""
    for name, value in (("KEY_BYTES", 0), ("TABLE_BYTES", 0), ("RANGES", 7)):
        monkeypatch.setattr(order, name, value)


def test_few_requests_cut_the_table_before_a_shuffle(spark, tmp_path):
    from datetime import datetime

    now = datetime(2024, 1, 1)
    spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("field"), F.col("id").cast("string").cast("binary").alias("value"), F.lit(None).cast("timestamp").alias("expire_at")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    req = spark.createDataFrame([(0, "k5", "5"), (1, "none", "x"), (2, "k5", "5")], "pos int, key string, field string")
    member = t.select("key", F.col("field").alias("member"))
    asked = req.withColumnRenamed("field", "member")
    for df in (
        keyspace.mget(t, req, now), keyspace.ttl(t, req, now), keyspace.exists(t, req, now), hashes.hmget(t.select("key", "field", "value"), req), sets.smismember(member, asked),
        zsets.zmscore(member.withColumn("score", F.lit(1.0)), asked), geo.geopos(member.withColumns({"lon": F.lit(1.0), "lat": F.lit(1.0)}), asked),
        bitmaps.getbit(t.select("key", F.lit(0).cast("long").alias("byte"), F.lit(128).alias("bits")), req.select("pos", "key", F.lit(0).cast("long").alias("offset"))),
    ):
        assert "BroadcastHashJoin" in plan(df) and "LeftSemi" in plan(df)
    assert [(r["pos"], r["value"]) for r in keyspace.mget(t, req, now).orderBy("pos").collect()] == [(0, b"5"), (1, None), (2, b"5")]


def test_many_requests_give_the_same(spark, monkeypatch):
    t = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    req = spark.createDataFrame([(i, i % 60) for i in range(100)], "pos int, key long")
    want = sorted(map(str, order.lookup(req, t, "key").collect()))
    monkeypatch.setattr(order, "SMALL_BYTES", 0)
    monkeypatch.setattr(order, "BROADCAST_KEYS", 5)
    assert "LeftSemi" not in plan(order.lookup(req, t, "key"))
    assert sorted(map(str, order.lookup(req, t, "key").collect())) == want


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_of_a_large_table(spark, large, kind):
    df = spark.range(5000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, 17).otherwise(F.xxhash64("id") % 900).cast(kind).alias("k"), "id")
    got = order.numbered(df, "n", F.col("k"), "id")
    assert "SinglePartition" not in plan(got).replace("Window [sum", "").split("BroadcastExchange")[0]
    rows = got.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(5000))
    assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


@pytest.mark.parametrize("reverse", [False, True])
def test_one_hot_key_is_ranked_in_ranges(spark, monkeypatch, reverse):
    z = spark.range(200_000, numPartitions=8).select(F.when(F.col("id") % 1000 == 0, "cold").otherwise("hot").alias("key"), F.format_string("m%06d", "id").alias("member"), (F.col("id") * 7919 % 1000).cast("double").alias("score"))
    digest = lambda: tuple(zsets.zrank(z, reverse=reverse).agg(F.sum(F.xxhash64("key", "member", "rank") % 1000003), F.count("*")).first())
    some = lambda: sorted(map(tuple, zsets.zrange(z, -3, -1, reverse).collect()))
    want = digest(), some()
    monkeypatch.setattr(order, "KEY_BYTES", 0)
    ranged = zsets.zrank(z, reverse=reverse)
    assert "key" in plan(ranged) and "_range" in plan(ranged)
    assert (digest(), some()) == want


def test_lists_and_ranks_by_ranges(spark, monkeypatch, large):
    items = spark.range(300).select((F.col("id") % 3).cast("string").alias("key"), (F.col("id") * 7 % 301).alias("pos"), F.col("id").cast("string").alias("value"))
    ways = []
    for bytes_ in (0, 1 << 30):
        monkeypatch.setattr(order, "KEY_BYTES", bytes_)
        ways.append([sorted(map(str, df.collect())) for df in (lists.lrange(items, 2, -90), lists.lindex(items, -2), lists.ltrim(items, 1, 3), lists.lpos(items, F.lit("9"), -1))])
    assert ways[0] == ways[1]


def test_documents_and_changes_are_numbered_in_ranges(spark, large):
    base = spark.range(400).select(F.col("id").alias("doc_seq"), F.col("id").cast("string").alias("doc_id"), F.parse_json(F.lit("{}")).alias("body"))
    new = spark.range(1000).select(F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("doc_id"), F.lit('{"a": 1}').alias("json"))
    made = docs.set_(base, new).where("doc_id like 'n%'").orderBy("doc_seq").select("doc_seq", "doc_id").collect()
    assert [tuple(r) for r in made] == [(400 + i, f"n{i:04d}") for i in range(1000)]
    before = spark.range(500).select(F.lpad("id", 4, "0").alias("key"), F.lit(b"1").alias("value"))
    log = cdc.changes(before, before.where("key >= '0100'").withColumn("value", F.lit(b"2")), 10, 1).orderBy("seq").collect()
    assert [(r["seq"], r["op"], r["key"]) for r in log] == [(10 + i, "DEL" if i < 100 else "SET", f"{i:04d}") for i in range(500)]


def test_a_snapshot_survives_its_own_folder_and_dead_writers(spark, tmp_path):
    f = str(tmp_path / "snap")
    db = Database(spark)
    db.execute("SET", "k", "1")
    db.execute("DOC.CREATE", "c")
    db.execute("DOC.SET", "c", "a", '{"x": 1}')
    db.save(f)
    again = Database.load(spark, f)
    again.execute("SET", "k", "2")
    for _ in range(3):
        again.save(f)  # over the folder that it was read from
        assert again.execute("GET", "k") == b"2"
    assert len(snapshot.versions(spark, f)) == 2
    broken = {"kv": again.t["kv"], "zset": spark.range(1).select(F.raise_error(F.lit("killed")).alias("x"))}
    with pytest.raises(Exception, match="killed"):
        snapshot.save(broken, f)  # dies between two tables
    back = Database.load(spark, f)
    assert back.execute("GET", "k") == b"2" and back.execute("DOC.GET", "c", "a") == {"x": 1}
    back.save(f)
    assert Database.load(spark, f).execute("GET", "k") == b"2"
    with pytest.raises(CommandError):
        snapshot.load(spark, str(tmp_path / "none"))


def test_segments_of_a_log(spark, tmp_path):
    f = str(tmp_path / "log")
    rows = lambda a, b: spark.createDataFrame([(i, i, "DEL" if i % 5 == 0 else "SET", f"k{i % 7}", None if i % 5 == 0 else str(i)) for i in range(a, b)], cdc.SCHEMA)
    for a in (0, 20, 40):
        snapshot.append_log(rows(a, a + 20), f)
        snapshot.rotate(spark, f)
    state = lambda: sorted(map(tuple, snapshot.replay(snapshot.read_log(spark, f)).collect()))
    want = sorted(map(tuple, snapshot.replay(rows(0, 60)).collect()))
    assert state() == want
    assert snapshot.truncate(spark, f, 19) == ["segment-00000001"]
    assert snapshot.read_log(spark, f).agg(F.min("seq")).first()[0] == 20
    snapshot.rewrite(spark, f)
    assert state() == want and snapshot.read_log(spark, f).count() == len(want)
    bad = rows(70, 75).withColumn("crc", F.lit(7).cast("long"))
    snapshot.append_log(rows(60, 70), f)
    bad.write.mode("append").partitionBy("op").parquet(f"{f}/{snapshot.segments(spark, f)[-1]}")
    snapshot.append_log(rows(75, 80), f)
    assert snapshot.read_log(spark, f).agg(F.max("seq")).first()[0] == 69


def test_layouts_are_read_in_part(spark, tmp_path):
    t = spark.range(20_000).select("id", (F.col("id") * 7919 % 5000).alias("v"))
    docs.store_layout(t, "v", "hash", 16, str(tmp_path / "hash"))
    laid = spark.read.parquet(str(tmp_path / "hash"))
    found = docs.seek(laid, "v", 77, 16)
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in t.where("v = 77").collect())
    assert "PartitionFilters: [isnotnull(_bucket" in plan(found)
    docs.store_layout(t, "v", "sorted", 16, str(tmp_path / "sorted"))
    files = spark.read.parquet(str(tmp_path / "sorted")).withColumn("f", F.input_file_name())
    spans = sorted(tuple(r) for r in files.groupBy("f").agg(F.min("v"), F.max("v")).select("min(v)", "max(v)").collect())
    assert len(spans) > 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert "PushedFilters: [IsNotNull(v), GreaterThanOrEqual(v,10)" in plan(spark.read.parquet(str(tmp_path / "sorted")).where("v >= 10 and v <= 20"))


def test_many_patterns_meet_by_their_text(spark):
    globs = [f"room{i}.*" for i in range(900)] + [f"*.user{i}" for i in range(200)] + ["*7*", "room1?.user3", "a+b*", "x" * 40 + "*"]
    subs = spark.createDataFrame([("c", "glob", g) for g in globs], "conn string, kind string, pattern string")
    names = [f"room{i}.user{i % 9}" for i in range(0, 60, 7)] + ["a+bc", "x" * 41, "x" * 39 + "y", "none", "room5.x\ny"]
    messages = spark.createDataFrame([(n, str(i)) for i, n in enumerate(names)], "channel string, message string")
    got = sorted((r["channel"], r["pattern"]) for r in pubsub.deliveries(messages, subs).collect())
    import fnmatch

    assert got == sorted((n, g) for n in names for g in globs if fnmatch.fnmatchcase(n, g))


def test_cells_of_a_stored_index(spark, tmp_path):
    v = spark.range(2000).select(F.lit("i").alias("index"), "id", F.array(*[F.sin(F.col("id") * (d + 1) * 0.37).cast("float") for d in range(8)]).alias("vec"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    truth = vectors.knn_join(v, q, 10)
    vectors.CellIndex(v).store(str(tmp_path / "cells"))
    index = vectors.CellIndex.open(spark, str(tmp_path / "cells"))
    assert vectors.recall(index.join(q, 10), truth).first()[0] >= 0.9
    assert vectors.recall(index.join(q, 10, 16), truth).first()[0] == 1.0
    found = index.search([float(x) for x in q.first()["vec"]], 5, 3)
    assert "PartitionFilters: [cell" in plan(found) or "PartitionFilters: [isnotnull(cell" in plan(found)


def test_not_keeps_trailing_zero_bytes(spark):
    b = spark.createDataFrame([("k", 0, 255)], "key string, byte long, bits int")
    n = spark.createDataFrame([("k", 3)], "key string, n long")
    assert sorted(map(tuple, bitmaps.bitop(b, "NOT", "d", ["k"], n).collect())) == [("d", 1, 255), ("d", 2, 255)]


def test_statistics_of_commands(spark):
    db = Database(spark)
    for _ in range(3):
        db.execute("SET", "hot", "1")
    db.execute("GET", "cold")
    assert db.execute("STATS.HOTKEYS", "1") == [["hot", 3]]
    got = db.execute("STATS.LATENCY", "set", "50", "99")
    assert 0 < got["p50"] <= got["p99"]
    assert db.execute("STATS.LATENCY", "zadd", "50") == {"p50": 0.0}
    db.execute("INCR", "n")
    assert db.execute("OBJECT", "ENCODING", "n") == "int"


def test_setbit_keeps_the_other_bits_of_its_byte(spark):
    """Where a byte is taken already, which happens on large tables only; the SQL of bitmap_setbit holds where it is not."""
    b = bitmaps.from_offsets(spark.createDataFrame([("click", i) for i in (4000, 4003, 4007, 9)] + [("view", 4004)], "key string, offset long"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bitmaps.setbit(b, "click", 4004, True)) == [("click", 1, 64), ("click", 500, 0b10011001), ("view", 500, 8)]
    assert rows(bitmaps.setbit(b, "click", 4003, False)) == [("click", 1, 64), ("click", 500, 0b10000001), ("view", 500, 8)]
