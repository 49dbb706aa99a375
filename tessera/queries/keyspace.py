"""Queries on the string keyspace, lists, hashes and sets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import hashes, keyspace, lists, sets
from tessera.queries.base import NOW, T, query

KEYS = [(0, "Customer#000000001"), (1, "Customer#000000003"), (2, "nobody"), (3, "Customer#000000001"), (4, "Customer#000000027")]
_REQ = "req(pos, key) AS (VALUES (0, 'Customer#000000001'), (1, 'Customer#000000003'), (2, 'nobody'), (3, 'Customer#000000001'), (4, 'Customer#000000027'))"


def req(t: T) -> DataFrame:
    return t.rows(KEYS, "pos int, key string")


def text(df: DataFrame, c: str = "value") -> DataFrame:
    return df.withColumn(c, F.col(c).cast("string"))


@query("SELECT value FROM live WHERE key = 'Customer#000000002'")
def str_get(t: T) -> DataFrame:
    return text(keyspace.get(t.kv, "Customer#000000002", NOW))


@query(f", {_REQ} SELECT pos, key, value FROM req LEFT JOIN live USING (key)")
def str_mget(t: T) -> DataFrame:
    return text(keyspace.mget(t.kv, req(t), NOW))


@query("SELECT key, strlen(value) AS length FROM live")
def str_strlen(t: T) -> DataFrame:
    return keyspace.strlen(t.kv, NOW)


@query("SELECT key, CASE WHEN greatest(length(value) - 6, 0) > least(length(value) - 2, length(value) - 1) THEN '' ELSE substr(value, greatest(length(value) - 6, 0) + 1, length(value) - 2 - greatest(length(value) - 6, 0) + 1) END AS value FROM live")
def str_getrange(t: T) -> DataFrame:
    return text(keyspace.getrange(t.kv, -6, -2, NOW))


@query("SELECT key, substr(value, 1, 3) || 'XYZ' || substr(value, 7) AS value FROM live")
def str_setrange(t: T) -> DataFrame:
    return text(keyspace.setrange(t.kv, 3, b"XYZ", NOW)).drop("expire_at")


@query("SELECT key, CASE WHEN l.key IS NULL THEN n.more ELSE l.value || n.more END AS value FROM (SELECT s_name AS key, '+' || s_suppkey AS more FROM supplier UNION ALL SELECT c_name, '+' || c_custkey FROM customer WHERE c_nationkey = 3) n LEFT JOIN live l USING (key)")
def str_append(t: T) -> DataFrame:
    new = t.supplier.select(F.col("s_name").alias("key"), F.concat(F.lit("+"), F.col("s_suppkey")).cast("binary").alias("value"))
    new = new.unionByName(t.customer.where("c_nationkey = 3").select(F.col("c_name").alias("key"), F.concat(F.lit("+"), F.col("c_custkey")).cast("binary").alias("value")))
    return text(keyspace.append(t.kv, new, NOW).join(new.select("key"), "key", "left_semi")).select("key", "value")


def _named(t: T) -> DataFrame:
    c = t.customer.where("c_nationkey < 5").select(F.col("c_name").alias("key"), F.lit("new").cast("binary").alias("value"))
    return c.unionByName(t.supplier.select(F.col("s_name").alias("key"), F.lit("new").cast("binary").alias("value")))


_NEW = "new AS (SELECT c_name AS key, 'new' AS value FROM customer WHERE c_nationkey < 5 UNION ALL SELECT s_name, 'new' FROM supplier)"


@query(f", {_NEW} SELECT key, value, expire_at FROM kv WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key, value, NULL FROM new")
def str_set(t: T) -> DataFrame:
    return text(keyspace.set_(t.kv, _named(t), NOW))


@query(f", {_NEW}, n AS (SELECT * FROM new WHERE key NOT IN (SELECT key FROM live)) SELECT key, value, expire_at FROM kv WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, value, NULL FROM n")
def str_set_nx(t: T) -> DataFrame:
    return text(keyspace.set_(t.kv, _named(t), NOW, "NX"))


@query(f", {_NEW}, n AS (SELECT * FROM new WHERE key IN (SELECT key FROM live)) SELECT key, value, expire_at FROM kv WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, value, NULL FROM n")
def str_set_xx(t: T) -> DataFrame:
    return text(keyspace.set_(t.kv, _named(t), NOW, "XX"))


@query(f", {_NEW} SELECT key, CASE WHEN key IN (SELECT key FROM live) THEN 0 ELSE 1 END AS set FROM new")
def str_setnx(t: T) -> DataFrame:
    return keyspace.setnx(t.kv, _named(t), NOW)


@query("SELECT c_name AS key, TIMESTAMP '2024-01-16' + INTERVAL 90 SECOND AS expire_at FROM customer")
def str_setex(t: T) -> DataFrame:
    new = t.customer.select(F.col("c_name").alias("key"), F.lit(b"v").alias("value"), F.lit(NOW + timedelta(seconds=90)).alias("expire_at"))
    return keyspace.set_(t.kv, new, NOW).select("key", "expire_at")


@query("SELECT o_custkey AS key, o_orderstatus AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def str_mset(t: T) -> DataFrame:
    new = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("value"))
    return keyspace.set_(new.limit(0).select("key", "value", F.lit(None).cast("timestamp").alias("expire_at")), new, NOW).select("key", "value")


@query("SELECT (SELECT count(*) FROM kv) + (SELECT count(*) FROM supplier) AS n")
def str_msetnx(t: T) -> DataFrame:
    new = t.supplier.select(F.col("s_name").alias("key"), F.lit(b"v").alias("value"))
    return keyspace.msetnx(t.kv, new, NOW).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM kv")
def str_msetnx_taken(t: T) -> DataFrame:
    return keyspace.msetnx(t.kv, _named(t), NOW).agg(F.count("*").alias("n"))


@query(f", {_NEW} SELECT key, l.value AS old FROM new LEFT JOIN live l USING (key)")
def str_getset(t: T) -> DataFrame:
    return text(keyspace.getset(t.kv, _named(t), NOW), "old")


@query("SELECT c_name AS key, c_custkey * 7 + coalesce(s, 0) AS value FROM customer JOIN (SELECT o_custkey, sum(o_orderkey % 100 - 50) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def str_incrby(t: T) -> DataFrame:
    deltas = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("key"), (F.col("o_orderkey") % 100 - 50).alias("delta"))
    return keyspace.incrby(t.counters, deltas, NOW)


@query("SELECT c_name AS key, c_custkey * 7 - 1 AS value FROM customer")
def str_decr(t: T) -> DataFrame:
    return keyspace.incrby(t.counters, t.customer.select(F.col("c_name").alias("key"), F.lit(-1).cast("bigint").alias("delta")), NOW)


@query("SELECT c_name AS key, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 7 + c_custkey // 2 AS VARCHAR) ELSE CAST(c_custkey * 7 + c_custkey // 2 AS VARCHAR) || '.5' END AS value FROM customer")
def str_incrbyfloat(t: T) -> DataFrame:
    return keyspace.incrbyfloat(t.counters, t.customer.select(F.col("c_name").alias("key"), (F.col("c_custkey") / 2).alias("delta")), NOW)


@query(f", {_REQ} SELECT pos, key, value, (SELECT count(*) FROM kv WHERE key NOT IN (SELECT key FROM req)) AS n FROM req LEFT JOIN live USING (key)")
def str_getdel(t: T) -> DataFrame:
    answers, rest = keyspace.getdel(t.kv, req(t), NOW)
    return text(answers).crossJoin(rest.agg(F.count("*").alias("n")))  # one row


@query(f", {_REQ} SELECT key, value, CASE WHEN key IN (SELECT key FROM req WHERE pos = 4) THEN NULL WHEN key IN (SELECT key FROM req WHERE pos < 4) THEN TIMESTAMP '2024-01-17' ELSE expire_at END AS expire_at FROM live")
def str_getex(t: T) -> DataFrame:
    at = req(t).select("pos", "key", F.when(F.col("pos") < 4, F.lit(NOW + timedelta(days=1))).alias("expire_at")).dropDuplicates(["key"])
    return text(keyspace.getex(t.kv, at, NOW)[1])


@query(f", {_REQ} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM req)")
def key_del(t: T) -> DataFrame:
    return text(keyspace.delete(t.kv, req(t))).drop("expire_at")


@query(f", {_REQ} SELECT count(*) AS n FROM kv WHERE key IN (SELECT key FROM req)")
def key_del_count(t: T) -> DataFrame:
    return keyspace.deleted(t.kv, req(t))


@query(f", {_REQ} SELECT count(*) AS n FROM req WHERE key IN (SELECT key FROM live)")
def key_exists(t: T) -> DataFrame:
    return keyspace.exists(t.kv, req(t), NOW)


@query(", q AS (SELECT c_custkey AS pos, c_name AS key FROM customer) SELECT pos, key, CASE WHEN l.key IS NULL THEN -2 WHEN l.expire_at IS NULL THEN -1 ELSE CAST(epoch(l.expire_at) - epoch(TIMESTAMP '2024-01-16') AS BIGINT) END AS ttl FROM q LEFT JOIN live l USING (key)")
def key_ttl(t: T) -> DataFrame:
    return keyspace.ttl(t.kv, t.customer.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("key")), NOW)


@query(", q AS (SELECT c_custkey AS pos, c_name AS key FROM customer) SELECT pos, key, CASE WHEN l.key IS NULL THEN -2 WHEN l.expire_at IS NULL THEN -1 ELSE epoch_ms(l.expire_at) - epoch_ms(TIMESTAMP '2024-01-16') END AS ttl FROM q LEFT JOIN live l USING (key)")
def key_pttl(t: T) -> DataFrame:
    return keyspace.ttl(t.kv, t.customer.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("key")), NOW, millis=True)


@query("SELECT key, CASE WHEN CAST(right(key, 9) AS INT) % 4 = 1 THEN TIMESTAMP '2024-02-01' ELSE expire_at END AS expire_at FROM live WHERE CAST(right(key, 9) AS INT) % 4 <> 0")
def key_expireat(t: T) -> DataFrame:
    k = F.right("c_name", F.lit(9)).cast("int") % 4
    at = t.customer.where(k < 2).select(F.col("c_name").alias("key"), F.when(k == 1, F.lit(datetime(2024, 2, 1))).otherwise(F.lit(datetime(2024, 1, 2))).alias("expire_at"))
    return keyspace.expire(t.kv, at, NOW).select("key", "expire_at")


@query("SELECT key, CASE WHEN CAST(right(key, 9) AS INT) % 2 = 1 THEN expire_at END AS expire_at FROM live")
def key_persist(t: T) -> DataFrame:
    return keyspace.persist(t.kv, t.customer.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key")), NOW).select("key", "expire_at")


@query(", q AS (SELECT 'BUILDING' AS key, 0 AS pos UNION ALL SELECT 'nation:3', 1 UNION ALL SELECT 'Customer#000000005', 2 UNION ALL SELECT 'nobody', 3), a AS (SELECT DISTINCT key, 'string' AS type FROM kv UNION SELECT key, 'hash' FROM hash_fields UNION SELECT key, 'zset' FROM zset) SELECT pos, key, coalesce(type, 'none') AS type FROM q LEFT JOIN a USING (key)")
def key_type(t: T) -> DataFrame:
    q = t.rows([(0, "BUILDING"), (1, "nation:3"), (2, "Customer#000000005"), (3, "nobody")], "pos int, key string")
    return keyspace.type_of({"string": t.kv, "hash": t.hash_fields, "zset": t.zset}, q)


@query("SELECT key FROM live WHERE regexp_full_match(key, 'Customer#.*1.*7')")
def key_keys_glob(t: T) -> DataFrame:
    return keyspace.keys(t.kv, "Customer#*1*7", NOW)


@query("SELECT p_partkey AS id FROM part WHERE p_name LIKE '%a_e%'")
def glob_match(t: T) -> DataFrame:
    from tessera.functions.text import glob

    return t.part.where(glob(F.col("p_name"), "*a?e*")).select(F.col("p_partkey").alias("id"))


@query("SELECT key, 35 AS next FROM (SELECT key FROM live WHERE key LIKE 'Customer#%' ORDER BY key LIMIT 15 OFFSET 20)")
def key_scan(t: T) -> DataFrame:
    return keyspace.scan(t.kv, 20, NOW, "Customer#*", 15)


@query("SELECT count(*) AS n FROM kv")
def key_dbsize(t: T) -> DataFrame:
    return keyspace.dbsize(t.kv)


@query("SELECT key, value, expire_at FROM kv WHERE key NOT IN ('Customer#000000001', 'Customer#000000002') UNION ALL SELECT 'Customer#000000002', value, expire_at FROM kv WHERE key = 'Customer#000000001'")
def key_rename(t: T) -> DataFrame:
    return text(keyspace.rename(t.kv, "Customer#000000001", "Customer#000000002", NOW))


@query("SELECT key, value, expire_at FROM kv")
def key_renamenx_taken(t: T) -> DataFrame:
    return text(keyspace.rename(t.kv, "Customer#000000001", "Customer#000000002", NOW, only_free=True))


@query("SELECT key, value FROM kv UNION ALL SELECT 'copy', value FROM kv WHERE key = 'Customer#000000001'")
def key_copy(t: T) -> DataFrame:
    return text(keyspace.copy(t.kv, "Customer#000000001", "copy", NOW)).drop("expire_at")


@query("SELECT key, value FROM kv WHERE false")
def key_flush(t: T) -> DataFrame:
    return text(keyspace.flush(t.kv)).drop("expire_at")


@query("SELECT 1 AS n")
def key_random(t: T) -> DataFrame:
    return keyspace.randomkey(t.kv, NOW).agg(F.count("*").alias("n"))


@query("SELECT key, CASE WHEN regexp_full_match(value, '[0-9]+') THEN 'int' WHEN strlen(value) <= 23 THEN 'embstr' ELSE 'raw' END AS encoding FROM (FROM live UNION ALL SELECT 'n:' || key, value, expire_at FROM counters UNION ALL SELECT 'doc:' || doc_id, coalesce(text, ''), NULL FROM documents)")
def object_encoding(t: T) -> DataFrame:
    n = t.counters.withColumn("key", F.concat(F.lit("n:"), "key"))
    d = t.documents.select(F.concat(F.lit("doc:"), "doc_id").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("value"), F.lit(None).cast("timestamp").alias("expire_at"))
    return keyspace.object_encoding(t.kv.unionByName(n).unionByName(d), NOW)


@query("SELECT key, 1 AS refcount, 0 AS idletime FROM live")
def object_info(t: T) -> DataFrame:
    return keyspace.object_info(t.kv, NOW)


@query("SELECT l.key, 5 + CAST(floor(sqrt(coalesce(c, 0) / 5)) AS BIGINT) AS freq FROM live l LEFT JOIN (SELECT c_name AS key, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (key)")
def object_freq(t: T) -> DataFrame:
    return keyspace.object_freq(t.kv, t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("key")), NOW)


# --- lists

_RANKED = "r AS (SELECT key, pos, value, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM list_items)"


@query("SELECT key, count(*) AS length FROM list_items GROUP BY key")
def list_llen(t: T) -> DataFrame:
    return lists.length(t.list_items)


@query(f", {_RANKED} SELECT key, idx, value FROM r WHERE idx BETWEEN 1 AND n - 2")
def list_lrange(t: T) -> DataFrame:
    return lists.lrange(t.list_items, 1, -2)


@query(f", {_RANKED} SELECT key, idx, value FROM r WHERE idx = 0")
def list_lrange_clamped(t: T) -> DataFrame:
    return lists.lrange(t.list_items, 0, -100)


@query(f", {_RANKED} SELECT key, value FROM r WHERE idx = greatest(n - 2, 0)")
def list_lindex(t: T) -> DataFrame:
    return lists.lindex(t.list_items, -2)


@query(f", {_RANKED} SELECT key, pos, CASE WHEN idx = 0 THEN 'first' ELSE value END AS value FROM r")
def list_lset(t: T) -> DataFrame:
    return lists.lset(t.list_items, 0, F.lit("first"))


@query(", a AS (SELECT key, pos, 0 AS h, value FROM list_items UNION ALL SELECT key, min(pos), -1, 'inserted' FROM list_items WHERE value = 'assistant' GROUP BY key) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos, h) - 1 AS pos, value FROM a")
def list_linsert(t: T) -> DataFrame:
    return lists.linsert(t.list_items, F.lit("assistant"), F.lit("inserted"))


@query("SELECT key, pos, value FROM list_items QUALIFY value <> 'user' OR row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) > 2")
def list_lrem(t: T) -> DataFrame:
    return lists.lrem(t.list_items, -2, F.lit("user"))


@query(f", {_RANKED} SELECT key, pos, value FROM r WHERE idx >= 1")
def list_ltrim(t: T) -> DataFrame:
    return lists.ltrim(t.list_items, 1, -1)


@query(f", {_RANKED} SELECT key, idx FROM r WHERE value = 'user' QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx) BETWEEN 2 AND 3")
def list_lpos(t: T) -> DataFrame:
    return lists.lpos(t.list_items, F.lit("user"), rank=2, count=2)


@query(f", {_RANKED} SELECT key, idx FROM r WHERE value = 'user' QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1")
def list_lpos_from_tail(t: T) -> DataFrame:
    return lists.lpos(t.list_items, F.lit("user"), rank=-1)


@query("SELECT key, value FROM list_items QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1")
def list_lpop(t: T) -> DataFrame:
    return lists.pop(t.list_items)[0]


@query("SELECT key, pos, value FROM list_items QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) > 1")
def list_rpop_rest(t: T) -> DataFrame:
    return lists.pop(t.list_items, left=False)[1]


@query("SELECT key, pos, value FROM list_items UNION ALL SELECT key, lo - i, v FROM (SELECT key, min(pos) AS lo FROM list_items GROUP BY key), (VALUES (1, 'a'), (2, 'b')) w(i, v)")
def list_lpush(t: T) -> DataFrame:
    return lists.push(t.list_items, t.list_items.select("key").distinct().selectExpr("key", "stack(2, 1, 'a', 2, 'b') as (ord, value)"), left=True)


@query("SELECT key, pos, value FROM list_items UNION ALL SELECT key, hi + i, v FROM (SELECT key, max(pos) AS hi FROM list_items GROUP BY key), (VALUES (1, 'a'), (2, 'b')) w(i, v)")
def list_rpush(t: T) -> DataFrame:
    return lists.push(t.list_items, t.list_items.select("key").distinct().selectExpr("key", "stack(2, 1, 'a', 2, 'b') as (ord, value)"))


_WORD_LISTS = "w AS (SELECT CASE WHEN p_size < 25 THEN 'small' ELSE 'large' END AS key, p_partkey AS pos, p_name AS value FROM part)"


def _word_lists(t: T) -> DataFrame:
    return t.part.select(F.when(F.col("p_size") < 25, "small").otherwise("large").alias("key"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("value"))


@query(f", {_WORD_LISTS}, m AS (SELECT * FROM w WHERE key = 'small' ORDER BY pos DESC LIMIT 1) SELECT * FROM w WHERE NOT (key = 'small' AND pos = (SELECT pos FROM m)) UNION ALL SELECT 'large', (SELECT min(pos) FROM w WHERE key = 'large') - 1, value FROM m")
def list_lmove(t: T) -> DataFrame:
    return lists.lmove(_word_lists(t), "small", "large", from_left=False, to_left=True)


@query(f", {_WORD_LISTS} SELECT key, value FROM w WHERE key = 'small' ORDER BY pos LIMIT 1")
def list_blpop(t: T) -> DataFrame:
    return lists.blocking_pop(_word_lists(t), t.rows([(0, "none"), (1, "small"), (2, "large")], "pos int, key string"))


@query(f", {_WORD_LISTS} SELECT key, value FROM w WHERE key = 'small' ORDER BY pos DESC LIMIT 1")
def list_brpop(t: T) -> DataFrame:
    return lists.blocking_pop(_word_lists(t), t.rows([(0, "none"), (1, "small"), (2, "large")], "pos int, key string"), left=False)


@query(f", {_WORD_LISTS}, m AS (SELECT * FROM w WHERE key = 'small' ORDER BY pos LIMIT 1) SELECT * FROM w WHERE NOT (key = 'small' AND pos = (SELECT pos FROM m)) UNION ALL SELECT 'large', (SELECT max(pos) FROM w WHERE key = 'large') + 1, value FROM m")
def list_blmove(t: T) -> DataFrame:
    return lists.blocking_move(_word_lists(t), "small", "large", from_left=True, to_left=False)


# --- hashes


def _more_fields(t: T) -> DataFrame:
    return t.nation.selectExpr("concat('nation:', n_nationkey) as key", "stack(2, 'region', 'r', 'size', n_name) as (field, value)")


_MORE = "m AS (SELECT 'nation:' || n_nationkey AS key, f AS field, CASE f WHEN 'region' THEN 'r' ELSE n_name END AS value FROM nation, (VALUES ('region'), ('size')) t(f))"


@query(f", {_MORE} SELECT * FROM m UNION ALL SELECT * FROM hash_fields WHERE field = 'name'")
def hash_hset(t: T) -> DataFrame:
    return hashes.hset(t.hash_fields, _more_fields(t))


@query("SELECT 'nation:' || n_nationkey AS key, 1 AS added FROM nation")
def hash_hset_added(t: T) -> DataFrame:
    return hashes.hset_added(t.hash_fields, _more_fields(t))


@query(f", {_MORE} SELECT * FROM hash_fields UNION ALL SELECT * FROM m WHERE field = 'size'")
def hash_hsetnx(t: T) -> DataFrame:
    return hashes.hsetnx(t.hash_fields, _more_fields(t))


@query("SELECT value FROM hash_fields WHERE key = 'nation:7' AND field = 'name'")
def hash_hget(t: T) -> DataFrame:
    return hashes.hget(t.hash_fields, "nation:7", "name")


_FIELDS = [(0, "nation:1", "name"), (1, "nation:1", "nothing"), (2, "nation:99", "name"), (3, "nation:2", "region")]
_FREQ = "q(pos, key, field) AS (VALUES (0, 'nation:1', 'name'), (1, 'nation:1', 'nothing'), (2, 'nation:99', 'name'), (3, 'nation:2', 'region'))"


@query(f", {_FREQ} SELECT pos, key, field, value FROM q LEFT JOIN hash_fields USING (key, field)")
def hash_hmget(t: T) -> DataFrame:
    return hashes.hmget(t.hash_fields, t.rows(_FIELDS, "pos int, key string, field string"))


@query(f", {_FREQ} SELECT pos, key, field, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS present FROM q LEFT JOIN hash_fields USING (key, field)")
def hash_hexists(t: T) -> DataFrame:
    return hashes.hexists(t.hash_fields, t.rows(_FIELDS, "pos int, key string, field string"))


@query(f", {_FREQ} SELECT * FROM hash_fields h WHERE NOT EXISTS (FROM q WHERE q.key = h.key AND q.field = h.field)")
def hash_hdel(t: T) -> DataFrame:
    return hashes.hdel(t.hash_fields, t.rows(_FIELDS, "pos int, key string, field string"))


@query("SELECT field, value FROM hash_fields WHERE key = 'nation:7'")
def hash_hgetall(t: T) -> DataFrame:
    return hashes.hgetall(t.hash_fields, "nation:7")


@query("SELECT field FROM hash_fields WHERE key = 'nation:7'")
def hash_hkeys(t: T) -> DataFrame:
    return hashes.hkeys(t.hash_fields, "nation:7")


@query("SELECT value FROM hash_fields WHERE key = 'nation:7'")
def hash_hvals(t: T) -> DataFrame:
    return hashes.hvals(t.hash_fields, "nation:7")


@query("SELECT key, count(*) AS length FROM hash_fields GROUP BY key")
def hash_hlen(t: T) -> DataFrame:
    return hashes.hlen(t.hash_fields)


@query("SELECT 'nation:' || n_nationkey AS key, 'region' AS field, n_regionkey + sum(c_custkey) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey")
def hash_hincrby(t: T) -> DataFrame:
    return hashes.hincrby(t.hash_fields, t.customer.select(F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("key"), F.lit("region").alias("field"), F.col("c_custkey").alias("delta")))


@query("SELECT 'nation:' || n_nationkey AS key, 'region' AS field, n_regionkey || '.5' AS value FROM nation")
def hash_hincrbyfloat(t: T) -> DataFrame:
    return hashes.hincrbyfloat(t.hash_fields, t.nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("key"), F.lit("region").alias("field"), F.lit(0.5).alias("delta")))


@query("SELECT 2 AS distinct_fields, 5 AS draws")
def hash_hrandfield(t: T) -> DataFrame:
    a, b = hashes.random_fields(t.hash_fields, "nation:7", 3), hashes.random_fields(t.hash_fields, "nation:7", -5)
    return a.agg(F.count("*").alias("distinct_fields")).crossJoin(b.agg(F.count("*").alias("draws")))  # one row each


@query("SELECT key, field, value FROM hash_fields WHERE key LIKE 'nation:1%' ORDER BY key, field LIMIT 7 OFFSET 3")
def hash_hscan(t: T) -> DataFrame:
    return hashes.page(t.hash_fields.withColumn("k", F.concat_ws(" ", "key", "field")), "k", 3, "nation:1*", 7).drop("k")


# --- sets

_U, _H, _L = "1-URGENT", "2-HIGH", "5-LOW"


@query(f"SELECT DISTINCT member FROM set_members WHERE key IN ('{_U}', '{_H}')")
def set_sunion(t: T) -> DataFrame:
    return sets.sunion(t.set_members, [_U, _H])


@query(f"SELECT member FROM set_members WHERE key = '{_U}' INTERSECT SELECT member FROM set_members WHERE key = '{_H}' INTERSECT SELECT member FROM set_members WHERE key = '{_L}'")
def set_sinter(t: T) -> DataFrame:
    return sets.sinter(t.set_members, [_U, _H, _L])


@query(f"SELECT member FROM set_members WHERE key = '{_U}' EXCEPT SELECT member FROM set_members WHERE key IN ('{_H}', '{_L}')")
def set_sdiff(t: T) -> DataFrame:
    return sets.sdiff(t.set_members, [_U, _H, _L])


@query(f"SELECT key, member FROM set_members WHERE key <> '{_L}' UNION ALL SELECT '{_L}', member FROM (SELECT member FROM set_members WHERE key = '{_U}' INTERSECT SELECT member FROM set_members WHERE key = '{_H}')")
def set_sinterstore(t: T) -> DataFrame:
    return sets.store(t.set_members, _L, sets.sinter(t.set_members, [_U, _H]))


@query(f"SELECT 'all' AS key, member FROM (SELECT DISTINCT member FROM set_members WHERE key IN ('{_U}', '{_H}')) UNION ALL SELECT key, member FROM set_members")
def set_sunionstore(t: T) -> DataFrame:
    return sets.store(t.set_members, "all", sets.sunion(t.set_members, [_U, _H]))


@query(f"SELECT 'only' AS key, member FROM (SELECT member FROM set_members WHERE key = '{_U}' EXCEPT SELECT member FROM set_members WHERE key = '{_H}') UNION ALL SELECT key, member FROM set_members")
def set_sdiffstore(t: T) -> DataFrame:
    return sets.store(t.set_members, "only", sets.sdiff(t.set_members, [_U, _H]))


@query(f"SELECT least(25, (SELECT count(*) FROM (SELECT member FROM set_members WHERE key = '{_U}' INTERSECT SELECT member FROM set_members WHERE key = '{_H}'))) AS n")
def set_sintercard(t: T) -> DataFrame:
    return sets.sintercard(t.set_members, [_U, _H], 25)


@query("SELECT key, count(*) AS cardinality FROM set_members GROUP BY key")
def set_scard(t: T) -> DataFrame:
    return sets.scard(t.set_members)


@query(f"SELECT member FROM set_members WHERE key = '{_U}'")
def set_smembers(t: T) -> DataFrame:
    return sets.smembers(t.set_members, _U)


@query(f", q AS (SELECT c_custkey AS pos, '{_U}' AS key, c_custkey AS member FROM customer) SELECT pos, key, member, CASE WHEN EXISTS (FROM set_members s WHERE s.key = q.key AND s.member = q.member) THEN 1 ELSE 0 END AS present FROM q")
def set_smismember(t: T) -> DataFrame:
    return sets.smismember(t.set_members, t.customer.select(F.col("c_custkey").alias("pos"), F.lit(_U).alias("key"), F.col("c_custkey").alias("member")))


@query(f"SELECT key, member FROM set_members UNION SELECT '{_U}', c_custkey FROM customer")
def set_sadd(t: T) -> DataFrame:
    return sets.sadd(t.set_members, t.customer.select(F.lit(_U).alias("key"), F.col("c_custkey").alias("member")))


@query(f"SELECT '{_U}' AS key, count(*) AS added FROM customer WHERE c_custkey NOT IN (SELECT member FROM set_members WHERE key = '{_U}')")
def set_sadd_count(t: T) -> DataFrame:
    return sets.sadd_count(t.set_members, t.customer.select(F.lit(_U).alias("key"), F.col("c_custkey").alias("member")))


@query(f"SELECT key, member FROM set_members WHERE NOT (key = '{_U}' AND member % 2 = 0)")
def set_srem(t: T) -> DataFrame:
    return sets.srem(t.set_members, t.customer.where("c_custkey % 2 = 0").select(F.lit(_U).alias("key"), F.col("c_custkey").alias("member")))


@query(f", m AS (SELECT min(member) AS x FROM set_members WHERE key = '{_U}') SELECT key, member FROM set_members, m WHERE NOT (key = '{_U}' AND member = x) UNION SELECT '{_L}', x FROM m")
def set_smove(t: T) -> DataFrame:
    first = t.set_members.where(F.col("key") == _U).agg(F.min("member")).first()[0]
    return sets.smove(t.set_members, _U, _L, first)


@query(f"SELECT (SELECT count(*) FROM set_members WHERE key = '{_U}') - 5 AS left_over, 5 AS popped")
def set_spop(t: T) -> DataFrame:
    out, rest = sets.spop(t.set_members, _U, 5)
    return rest.where(F.col("key") == _U).agg(F.count("*").alias("left_over")).crossJoin(out.agg(F.count("*").alias("popped")))  # one row each


@query("SELECT 9 AS n")
def set_srandmember(t: T) -> DataFrame:
    return sets.random_members(t.set_members, _U, -9).agg(F.count("*").alias("n"))


@query(f"SELECT member FROM (SELECT CAST(member AS VARCHAR) AS member FROM set_members WHERE key = '{_U}') WHERE member LIKE '1%' ORDER BY member LIMIT 8 OFFSET 4")
def set_sscan(t: T) -> DataFrame:
    return hashes.page(sets.smembers(t.set_members, _U).select(F.col("member").cast("string").alias("member")), "member", 4, "1*", 8)
