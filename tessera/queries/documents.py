"""Queries on document collections, publish/subscribe, change capture and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.database import Database
from tessera.errors import CommandError
from tessera.operators import docs
from tessera.plans.where import Find, parse_find
from tessera.queries.base import NOW, T, query
from tessera.sources import snapshot
from tessera.streaming import cdc, pubsub, windows

_FLAGSHIP = "WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 ORDER BY c_acctbal DESC LIMIT 20 PROJECT c_name c_mktsegment c_acctbal"


@query("SELECT c_name, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def doc_find_flagship(t: T) -> DataFrame:
    return docs.find(t.customer, parse_find(_FLAGSHIP.split(" ")), "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_size > 10 AND p_brand = 'Brand#11') AND p_retailprice >= 950 ORDER BY p_size, p_partkey LIMIT 50 OFFSET 25")
def doc_find_page(t: T) -> DataFrame:
    return docs.find(t.part, Find("NOT (p_size > 10 AND p_brand = 'Brand#11') AND p_retailprice >= 950", "p_size", limit=50, offset=25, project=("p_partkey", "p_name")), "p_partkey")


@query("SELECT count(*) AS n FROM part WHERE p_type <> '5' AND coalesce(p_size <> 7, true)")
def doc_count(t: T) -> DataFrame:
    return docs.count(t.part, "p_type != 5 AND p_size != 7 AND nothing != 3")


@query("SELECT 0 AS n")
def doc_count_mismatch(t: T) -> DataFrame:
    return docs.count(t.part, "p_name = 5 OR p_name > 5 OR p_size = 'x' OR nothing = 1 OR nothing EXISTS")


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR NOT (lang = 'en')")
def doc_not_two_valued(t: T) -> DataFrame:
    return docs.find(t.documents, Find("NOT lang = 'en'", project=("doc_id", "lang")), "doc_id")


@query("SELECT a.c_custkey AS id FROM customer a JOIN nation ON n_nationkey = c_nationkey WHERE n_name LIKE 'NATION%' AND (n_regionkey = 1 OR n_regionkey = 3)")
def doc_find_nested(t: T) -> DataFrame:
    n = t.nation.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))
    nested = t.customer.join(n, F.col("n_nationkey") == F.col("c_nationkey")).where(F.col("nation.name").startswith("NATION"))
    return docs.find(nested, Find("nation.region IN (1, 3)"), "c_custkey").select(F.col("c_custkey").alias("id"))


@query("SELECT event_id AS doc_seq FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 40 AND CAST(json_extract(props, '$.k') AS DOUBLE) < 60")
def doc_variant_where(t: T) -> DataFrame:
    return docs.find_variant(t.props, Find("k >= 40 AND k < 60")).select("doc_seq")


@query("SELECT event_id AS doc_seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events ORDER BY k DESC, event_id LIMIT 30")
def doc_variant_order(t: T) -> DataFrame:
    return docs.find_variant(t.props, Find("k EXISTS", "k", True, ("k",), 30)).select("doc_seq", F.col("k").cast("bigint").alias("k"))


@query("SELECT count(*) AS n FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) <> 42")
def doc_variant_count(t: T) -> DataFrame:
    return docs.count_variant(t.props, "k != 42 AND NOT k = 'x' AND NOT missing EXISTS")


@query("SELECT event_id AS doc_seq, CAST(json_extract(props, '$.k') AS BIGINT) + 5 AS k, 'v' AS tag, '[2,\"x\"]' AS list, NULL AS gone FROM events")
def doc_update(t: T) -> DataFrame:
    made = docs.update(t.props, [("INCR", "k", 5), ("SET", "a.tag", "v"), ("PUSH", "list", 1), ("PUSH", "list", 2), ("PUSH", "list", 1), ("PUSH", "list", "x"), ("PULL", "list", 1), ("SET", "gone", True), ("DEL", "gone")])
    listed = F.to_json(F.try_variant_get("body", "$.list", "variant")).alias("list")
    return made.select("doc_seq", F.try_variant_get("body", "$.k", "bigint").alias("k"), F.try_variant_get("body", "$.a.tag", "string").alias("tag"), listed, F.try_variant_get("body", "$.gone", "string").alias("gone"))


@query("SELECT event_id AS doc_seq, CAST(json_extract(props, '$.k') AS BIGINT) * CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 0 ELSE 1 END AS k FROM events")
def doc_update_where(t: T) -> DataFrame:
    return docs.update(t.props, [("SET", "k", 0)], "k < 50").select("doc_seq", F.try_variant_get("body", "$.k", "bigint").alias("k"))


@query("SELECT event_id AS doc_seq, 1 AS new FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 0 FROM events WHERE event_id % 2 <> 0 UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY s_name), 1 FROM supplier")
def doc_mset(t: T) -> DataFrame:
    new = t.events.where("event_id % 2 = 0").select(F.col("event_id").cast("string").alias("doc_id"), F.lit('{"new": 1}').alias("json"))
    new = new.unionByName(t.supplier.select(F.col("s_name").alias("doc_id"), F.lit('{"new": 1}').alias("json")))
    return docs.set_(t.props, new).select("doc_seq", F.coalesce(F.try_variant_get("body", "$.new", "int"), F.lit(0)).alias("new"))


@query("SELECT max(event_id) + 3 AS last, count(*) + 3 AS n FROM events")
def doc_insert(t: T) -> DataFrame:
    made = docs.insert(t.props, t.rows([(1, "{}"), (2, '{"a": [1]}'), (3, '{"b": null}')], "ord int, json string"))
    return made.agg(F.max("doc_seq").alias("last"), F.count("*").alias("n"))


@query("SELECT pos, id AS doc_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM (VALUES (0, '5'), (1, 'none'), (2, '7')) q(pos, id) LEFT JOIN events ON CAST(event_id AS VARCHAR) = id")
def doc_mget(t: T) -> DataFrame:
    got = docs.get(t.props, t.rows([(0, "5"), (1, "none"), (2, "7")], "pos int, doc_id string"))
    return got.select("pos", "doc_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"))


@query("SELECT pos, id AS doc_id, CASE WHEN event_id IS NULL THEN 0 ELSE 1 END AS present FROM (VALUES (0, '5'), (1, 'none')) q(pos, id) LEFT JOIN events ON CAST(event_id AS VARCHAR) = id")
def doc_exists(t: T) -> DataFrame:
    return docs.exists(t.props, t.rows([(0, "5"), (1, "none")], "pos int, doc_id string"))


@query("SELECT event_id AS doc_seq FROM events WHERE event_id NOT IN (5, 7)")
def doc_del(t: T) -> DataFrame:
    return docs.delete(t.props, t.rows([("5",), ("7",)], "doc_id string")).select("doc_seq")


@query("SELECT 'lang' AS path, count(DISTINCT lang) AS cardinality FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents")
def doc_dictinfo(t: T) -> DataFrame:
    made = t.documents.select(F.col("doc_id").alias("doc_seq"), F.col("doc_id").cast("string").alias("doc_id"), F.to_variant_object(F.struct("lang", "source", "n_chars")).alias("body"))
    return docs.dictionary_info(made, ["lang", "source", "n_chars"])


@query(", s AS (SELECT strlen(replace(props, ' ', '')) AS n FROM events) SELECT count(*) AS doc_count, CAST(sum(n) AS BIGINT) AS total_bytes, min(n) AS min_bytes, max(n) AS max_bytes, CAST(floor(sum(n) / count(*)) AS BIGINT) AS avg_bytes FROM s")
def doc_storage(t: T) -> DataFrame:
    return docs.storage_info(t.props)


@query("SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def doc_unique_violations(t: T) -> DataFrame:
    return docs.unique_violations(t.props, "k")


@query("SELECT 'c' AS collection, 'name' AS path, 'unique' AS kind")
def doc_indexes(t: T) -> DataFrame:
    c = t.nation.select(F.col("n_nationkey").cast("long").alias("doc_seq"), F.col("n_nationkey").cast("string").alias("doc_id"), F.to_variant_object(F.struct(F.col("n_name").alias("name"))).alias("body"))
    empty = t.rows([], "collection string, path string, kind string")
    two = docs.create_index(docs.create_index(empty, c, "c", "name", "unique"), c, "c", "other", "hash")
    return docs.drop_index(two, "c", "other")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 2000")
def doc_sorted_index_range(t: T) -> DataFrame:
    return docs.find(docs.layout(t.orders, "o_totalprice", "sorted", 8), Find("o_totalprice >= 1000 AND o_totalprice <= 2000"), "o_orderkey").select("o_orderkey")


@query("SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w = 'the')) > 0 AS hit FROM documents")
def doc_contains(t: T) -> DataFrame:
    arr = t.documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("words"))
    hit = docs.find(arr, Find("words CONTAINS 'the'"), "doc_id").select("doc_id", F.lit(True).alias("hit"))
    return arr.select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"))


# --- publish and subscribe


def _messages(t: T) -> DataFrame:
    return t.events.select(F.concat_ws(".", "event_type", F.col("user_id") % 10).alias("channel"), F.col("event_id").cast("string").alias("message"))


def _subscriptions(t: T) -> DataFrame:
    return t.rows([("a", "exact", "click.3"), ("a", "glob", "click.*"), ("b", "glob", "*.7"), ("c", "glob", "v?ew.1")], "conn string, kind string, pattern string")


_MS = "m AS (SELECT event_type || '.' || (user_id % 10) AS channel, CAST(event_id AS VARCHAR) AS message FROM events)"
_DEL = "d AS (SELECT channel, message, 'a' AS conn, NULL AS pattern FROM m WHERE channel = 'click.3' UNION ALL SELECT channel, message, 'a', 'click.*' FROM m WHERE channel LIKE 'click.%' UNION ALL SELECT channel, message, 'b', '*.7' FROM m WHERE channel LIKE '%.7' UNION ALL SELECT channel, message, 'c', 'v?ew.1' FROM m WHERE channel LIKE 'v_ew.1')"


@query(f", {_MS}, {_DEL} SELECT * FROM d")
def pubsub_deliveries(t: T) -> DataFrame:
    return pubsub.deliveries(_messages(t), _subscriptions(t))


@query(f", {_MS}, {_DEL} SELECT channel, message, coalesce(c, 0) AS receivers FROM m LEFT JOIN (SELECT channel, message, count(*) AS c FROM d GROUP BY ALL) USING (channel, message)")
def pubsub_publish(t: T) -> DataFrame:
    return pubsub.publish_counts(_messages(t), _subscriptions(t))


@query(f", {_MS} SELECT channel, message FROM m WHERE channel = 'view.1' OR channel LIKE 'error.%'")
def pubsub_subscribe(t: T) -> DataFrame:
    return pubsub.listen(_messages(t), ["view.1"], ["error.*"])


@query("SELECT * FROM (VALUES ('a', 'exact', 'click.3'), ('b', 'glob', '*.7')) v(conn, kind, pattern)")
def pubsub_unsubscribe(t: T) -> DataFrame:
    return pubsub.unsubscribe(pubsub.unsubscribe(_subscriptions(t), "a", kind="glob"), "c", ["v?ew.1"], "glob")


# --- change capture


def _log(t: T) -> DataFrame:
    return t.events.select(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_type") == "error", "DEL").otherwise("SET").alias("op"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.col("event_type").alias("value"))


_LOG = "l AS (SELECT event_id AS seq, (epoch_us(ts) // 1000) AS ts_ms, CASE event_type WHEN 'error' THEN 'DEL' ELSE 'SET' END AS op, 'u' || user_id AS key, event_type AS value FROM events)"


@query(f", {_LOG} SELECT * FROM l WHERE seq >= 500 ORDER BY seq LIMIT 40")
def cdc_poll(t: T) -> DataFrame:
    return cdc.poll(_log(t), 500, 40)


@query(f", {_LOG} SELECT (SELECT max(seq) + 1 FROM (SELECT seq FROM l WHERE seq > (SELECT max(seq) FROM l) - 100 ORDER BY seq LIMIT 10)) AS next, true AS gap")
def cdc_gap(t: T) -> DataFrame:
    return cdc.poll_status(cdc.keep_last(_log(t), 100), 5, 10)


@query(f", {_LOG} SELECT * FROM l WHERE key LIKE 'u1%'")
def cdc_pattern(t: T) -> DataFrame:
    return cdc.matching(_log(t), "u1*")


@query(f", {_LOG}, x AS (SELECT key, max_by(op, seq) AS op, max_by(value, seq) AS value FROM l GROUP BY key) SELECT key, value FROM x WHERE op = 'SET'")
def log_replay(t: T) -> DataFrame:
    return snapshot.replay(_log(t))


@query(f", {_LOG}, x AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT * FROM x WHERE op = 'SET'")
def log_compact(t: T) -> DataFrame:
    return snapshot.compact(_log(t))


def _pel(t: T) -> DataFrame:
    return _log(t).where("seq % 5 != 0").select(F.lit("g").alias("group"), F.concat(F.lit("c"), F.col("seq") % 3).alias("consumer"), "seq", (F.col("seq") * 1000).alias("delivered_ms"), F.lit(1).cast("long").alias("deliveries"))


@query(f", {_LOG} SELECT *, true AS redelivered FROM l WHERE seq % 5 <> 0 AND seq % 3 <> 0 AND 70000 - seq * 1000 >= 30000 UNION ALL (SELECT *, false FROM l WHERE seq >= 60 ORDER BY seq LIMIT 40 - (SELECT count(*) FROM l WHERE seq % 5 <> 0 AND seq % 3 <> 0 AND 70000 - seq * 1000 >= 30000))")
def cdc_group_read(t: T) -> DataFrame:
    return cdc.group_read(_log(t), cdc.group_create(t.rows([], "group string, next_seq long"), "g", 60), _pel(t), "g", "c0", 40, 70000)


@query(f", {_LOG} SELECT seq, 'c' || (seq % 3) AS consumer, 70000 - seq * 1000 AS idle, 1 AS deliveries FROM l WHERE seq % 5 <> 0 AND seq % 2 = 1")
def cdc_pending(t: T) -> DataFrame:
    done = _log(t).where("seq % 2 = 0").select(F.lit("g").alias("group"), "seq")
    return cdc.pending(cdc.ack(_pel(t), done), "g", 70000)


@query(", b AS (SELECT c_name AS key, c_mktsegment AS v FROM customer WHERE c_nationkey <> 7), a AS (SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN 'changed' ELSE c_mktsegment END AS v FROM customer WHERE c_nationkey <> 3), x AS (SELECT key, b.v AS o, a.v AS n FROM b FULL JOIN a USING (key) WHERE b.v IS DISTINCT FROM a.v) SELECT 99 + row_number() OVER (ORDER BY key) AS seq, 7 AS ts_ms, CASE WHEN n IS NULL THEN 'DEL' ELSE 'SET' END AS op, key, n AS value FROM x")
def cdc_changes(t: T) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    after = c.where("n != 3").withColumn("value", F.when(F.col("k") % 5 == 0, "changed").otherwise(F.col("value")))
    return cdc.changes(c.where("n != 7"), after, 100, 7)


# --- event time, on the batch form of the streaming plans


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(t: T) -> DataFrame:
    return windows.windowed_counts(t.events, "ts", "event_type", "1 day", "1 hour")


@query(", s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k")
def stream_sessions(t: T) -> DataFrame:
    return windows.sessions(t.events, "ts", "user_id", "6 hours", "1 hour")


# --- commands: their replies as text


def _replies(t: T, script: str) -> DataFrame:
    db = Database(t.spark, lambda: NOW)
    out = []
    for i, line in enumerate(script.strip().splitlines()):
        try:
            reply = db.execute(*line.strip().split(" "))
        except CommandError as e:
            reply = e
        out.append((i, str(reply)))
    return t.rows(out, "pos int, reply string")


def _expected(*replies: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(replies)) + ") v(pos, reply)"


@query(_expected("OK", "QUEUED", "QUEUED", "QUEUED", "ERR MULTI calls can not be nested", "[1, 2, b'2']", "ERR EXEC without MULTI", "OK", "QUEUED", "OK", "b'2'", "OK", "int", "['OBJECT FREQ|ENCODING|REFCOUNT|IDLETIME key']"))
def db_transaction(t: T) -> DataFrame:
    return _replies(t, "MULTI\nINCR n\nINCR n\nGET n\nMULTI\nEXEC\nEXEC\nMULTI\nDEL n\nDISCARD\nGET n\nWATCH n\nOBJECT ENCODING n\nOBJECT HELP")


@query(_expected("OK", "ERR collection already exists", "OK", "1", "{'doc_count': 2, 'dictionary_entries': 1, 'compression': 'none'}", "1", "ERR unknown collection", "0"))
def db_documents(t: T) -> DataFrame:
    made = _replies(t, 'DOC.CREATE c COMPRESSION none\nDOC.CREATE c\nDOC.SET c a {"x":"y"}\nDOC.INSERT c {"n":1}\nDOC.INFO c\nDOC.DROP c\nDOC.COUNT c WHERE n = 1\nDOC.DROP c')
    at = F.regexp_replace("reply", r"^\{'created_at': \d+, 'compression': 'none', (.*)\}$", "{$1, 'compression': 'none'}")
    return made.select("pos", at.alias("reply"))
