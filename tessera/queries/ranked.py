"""Queries on sorted sets, streams, sketches, bitmaps, positions and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import bitmaps, geo, hashes, sketches, stats, streams, vectors, zsets
from tessera.queries.base import T, query

# --- sorted sets


@query("SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zset")
def zset_zrank(t: T) -> DataFrame:
    return zsets.zrank(t.zset)


@query("SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zset")
def zset_zrevrank(t: T) -> DataFrame:
    return zsets.zrank(t.zset, reverse=True)


@query(", r AS (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zset) SELECT * FROM r WHERE member IN ('Customer#000000001', 'Customer#000000010')")
def zset_zrank_of(t: T) -> DataFrame:
    m = t.rows([("Customer#000000001",), ("Customer#000000010",)], "member string")
    return zsets.zrank(t.zset, m.crossJoin(t.zset.select("key").distinct()))  # two members and the few keys


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zset QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) BETWEEN 3 AND 12")
def zset_zrange(t: T) -> DataFrame:
    return zsets.zrange(t.zset, 2, 11)


@query("SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zset QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 5")
def zset_zrevrange(t: T) -> DataFrame:
    return zsets.zrange(t.zset, -5, -1, reverse=True)


@query("SELECT key, member, score FROM zset WHERE score BETWEEN 100 AND 900")
def zset_zrangebyscore(t: T) -> DataFrame:
    return zsets.zrangebyscore(t.zset, 100, 900)


@query("SELECT key, member, score FROM zset WHERE key = 'BUILDING' AND score >= -500 ORDER BY score DESC, member DESC LIMIT 10 OFFSET 5")
def zset_zrevrangebyscore(t: T) -> DataFrame:
    return zsets.zrangebyscore(t.zset, -500, "+inf", key="BUILDING", reverse=True, offset=5, count=10)


@query("SELECT key, member, score FROM zset WHERE score > 100 AND score < 900 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 3")
def zset_range_exclusive(t: T) -> DataFrame:
    return zsets.zrangebyscore(t.zset, "(100", "(900", count=3)


@query("SELECT key, count(*) FILTER (score BETWEEN 0 AND 5000) AS n FROM zset GROUP BY key")
def zset_zcount(t: T) -> DataFrame:
    return zsets.zcount(t.zset, 0, 5000)


@query("SELECT key, member, score FROM zset WHERE member >= 'Customer#000000100' AND member < 'Customer#000000200'")
def zset_zrangebylex(t: T) -> DataFrame:
    return zsets.zrangebylex(t.zset, "[Customer#000000100", "(Customer#000000200")


@query("SELECT key, member, score FROM zset WHERE key = 'MACHINERY' AND member > 'Customer#000000100' ORDER BY score DESC, member DESC LIMIT 6")
def zset_zrevrangebylex(t: T) -> DataFrame:
    return zsets.zrangebylex(t.zset, "(Customer#000000100", "+", key="MACHINERY", reverse=True, count=6)


@query("SELECT key, count(*) FILTER (member <= 'Customer#000000500') AS n FROM zset GROUP BY key")
def zset_zlexcount(t: T) -> DataFrame:
    return zsets.zlexcount(t.zset, "-", "[Customer#000000500")


@query("SELECT key, count(*) AS cardinality FROM zset GROUP BY key")
def zset_zcard(t: T) -> DataFrame:
    return zsets.zcard(t.zset)


@query(", q AS (SELECT c_custkey AS pos, 'BUILDING' AS key, c_name AS member FROM customer) SELECT pos, key, member, score FROM q LEFT JOIN zset USING (key, member)")
def zset_zmscore(t: T) -> DataFrame:
    return zsets.zmscore(t.zset, t.customer.select(F.col("c_custkey").alias("pos"), F.lit("BUILDING").alias("key"), F.col("c_name").alias("member")))


@query("SELECT 'BUILDING' AS key, c_name AS member, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END + 10 AS score FROM customer")
def zset_zincrby(t: T) -> DataFrame:
    return zsets.zincrby(t.zset, t.customer.select(F.lit("BUILDING").alias("key"), F.col("c_name").alias("member"), F.lit(10.0).alias("delta")))


@query("SELECT key, member, score FROM zset WHERE key <> 'BUILDING' UNION ALL SELECT 'BUILDING', c_name, 1.0 FROM customer")
def zset_zadd(t: T) -> DataFrame:
    return zsets.zadd(t.zset, t.customer.select(F.lit("BUILDING").alias("key"), F.col("c_name").alias("member"), F.lit(1.0).alias("score")))


@query("SELECT 'BUILDING' AS key, count(*) AS added FROM customer WHERE c_mktsegment <> 'BUILDING'")
def zset_zadd_count(t: T) -> DataFrame:
    return zsets.zadd_count(t.zset, t.customer.select(F.lit("BUILDING").alias("key"), F.col("c_name").alias("member")))


@query("SELECT key, member, score FROM zset WHERE right(member, 1) <> '5'")
def zset_zrem(t: T) -> DataFrame:
    return zsets.zrem(t.zset, t.zset.where(F.col("member").endswith("5")).select("key", "member"))


@query("SELECT key, member, score FROM zset QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) <= 4")
def zset_zpopmin(t: T) -> DataFrame:
    return zsets.zpop(t.zset, 4)[0]


@query("SELECT key, member, score FROM zset QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) > 4")
def zset_zpopmax_rest(t: T) -> DataFrame:
    return zsets.zpop(t.zset, 4, largest=True)[1]


@query("SELECT key, member, score FROM zset WHERE key = 'FURNITURE' ORDER BY score, member LIMIT 1")
def zset_bzpopmin(t: T) -> DataFrame:
    return zsets.blocking_zpop(t.zset, t.rows([(0, "none"), (1, "FURNITURE"), (2, "BUILDING")], "pos int, key string"))


@query("SELECT key, member, score FROM zset WHERE key = 'FURNITURE' ORDER BY score DESC, member DESC LIMIT 1")
def zset_bzpopmax(t: T) -> DataFrame:
    return zsets.blocking_zpop(t.zset, t.rows([(0, "none"), (1, "FURNITURE")], "pos int, key string"), largest=True)


@query("SELECT 12 AS n")
def zset_zrandmember(t: T) -> DataFrame:
    return zsets.random_members(t.zset, "BUILDING", -12).agg(F.count("*").alias("n"))


@query("SELECT member, score FROM zset WHERE key = 'BUILDING' AND member LIKE '%1' ORDER BY member LIMIT 10 OFFSET 10")
def zset_zscan(t: T) -> DataFrame:
    return hashes.page(t.zset.where("key = 'BUILDING'").select("member", "score"), "member", 10, "*1", 10)


# --- streams

_DAY = 1704758400000  # 2024-01-09


@query("SELECT key, count(*) AS length FROM stream_entries GROUP BY key")
def stream_xlen(t: T) -> DataFrame:
    return streams.xlen(t.stream_entries)


@query(f"SELECT * FROM stream_entries WHERE ms >= {_DAY} AND (ms < {_DAY + 86400000} OR (ms = {_DAY + 86400000} AND seq <= 3)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms, seq) <= 50")
def stream_xrange(t: T) -> DataFrame:
    return streams.xrange(t.stream_entries, f"{_DAY}-0", f"{_DAY + 86400000}-3", 50)


@query("SELECT * FROM stream_entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 20")
def stream_xrevrange(t: T) -> DataFrame:
    return streams.xrange(t.stream_entries, "-", "+", 20, reverse=True)


@query(f"SELECT * FROM stream_entries WHERE (key = 'click' AND (ms, seq) > ({_DAY}, 0)) OR (key = 'view' AND (ms, seq) > (0, 0)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms, seq) <= 30")
def stream_xread(t: T) -> DataFrame:
    return streams.xread(t.stream_entries, t.rows([("click", _DAY, 0), ("view", 0, 0)], "key string, after_ms long, after_seq long"), 30)


@query("SELECT * FROM stream_entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 100")
def stream_xtrim(t: T) -> DataFrame:
    return streams.xtrim(t.stream_entries, 100)


@query("SELECT key, greatest(count(*) - 100, 0) AS removed FROM stream_entries GROUP BY key")
def stream_xtrimmed(t: T) -> DataFrame:
    return streams.xtrimmed(t.stream_entries, 100)


@query("SELECT * FROM stream_entries WHERE event_id % 3 <> 0")
def stream_xdel(t: T) -> DataFrame:
    return streams.xdel(t.stream_entries, t.stream_entries.where("event_id % 3 = 0").select("key", "ms", "seq"))


@query(", n AS (SELECT key, max(ms) + 1 AS ms FROM stream_entries GROUP BY key) SELECT * FROM stream_entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 4 UNION ALL SELECT key, ms, 0, -1, -1, 0.0 FROM n")
def stream_xadd_maxlen(t: T) -> DataFrame:
    e = t.stream_entries
    new = e.groupBy("key").agg((F.max("ms") + 1).alias("ms")).select("key", "ms", F.lit(0).cast("long").alias("seq"), F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(0.0).alias("val"))
    return streams.xadd(e, new, 5)


@query("SELECT key, count(*) AS length, min_by(ms || '-' || seq, ms * 1000 + seq) AS first, max_by(ms || '-' || seq, ms * 1000 + seq) AS last, max_by(ms || '-' || seq, ms * 1000 + seq) AS last_generated, 0 AS groups FROM stream_entries GROUP BY key")
def stream_xinfo(t: T) -> DataFrame:
    return streams.xinfo_stream(t.stream_entries)


def _groups(t: T) -> DataFrame:
    return t.stream_entries.select("key").distinct().select("key", F.lit("g").alias("group"), F.lit(_DAY).cast("long").alias("last_ms"), F.lit(0).cast("long").alias("last_seq"))


@query(f"SELECT key, 'g' AS \"group\", count(DISTINCT consumer) AS consumers, count(*) AS pending, '{_DAY}-0' AS last_delivered FROM stream_pel GROUP BY key")
def stream_xinfo_groups(t: T) -> DataFrame:
    return streams.xinfo_groups(_groups(t), t.stream_pel)


@query(f"SELECT * FROM stream_entries WHERE (ms, seq) > ({_DAY}, 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms, seq) <= 10")
def stream_xreadgroup(t: T) -> DataFrame:
    return streams.read_new(t.stream_entries, _groups(t), "g", 10)


@query("SELECT e.* FROM stream_entries e JOIN stream_pel p USING (key, ms, seq) WHERE consumer = 'c2'")
def stream_replay(t: T) -> DataFrame:
    return streams.replay(t.stream_entries, t.stream_pel, "g", "c2")


@query("SELECT * FROM stream_pel WHERE ms % 2 = 1")
def stream_xack(t: T) -> DataFrame:
    return streams.xack(t.stream_pel, t.stream_pel.where("ms % 2 = 0").select("key", "group", "ms", "seq"))


@query("SELECT key, \"group\", consumer, count(*) AS pending, min_by(ms || '-' || seq, ms * 1000 + seq) AS first, max_by(ms || '-' || seq, ms * 1000 + seq) AS last FROM stream_pel GROUP BY ALL")
def stream_xpending(t: T) -> DataFrame:
    return streams.xpending(t.stream_pel)


@query(f"SELECT key, ms || '-' || seq AS id, consumer, {_DAY * 2} - delivered_ms AS idle, deliveries FROM stream_pel WHERE key = 'click' AND ms >= {_DAY} ORDER BY ms, seq LIMIT 25")
def stream_xpending_detail(t: T) -> DataFrame:
    return streams.xpending_detail(t.stream_pel.where("key = 'click'"), f"{_DAY}-0", "+", 25, _DAY * 2)


@query(f"SELECT key, \"group\", CASE WHEN x THEN 'c9' ELSE consumer END AS consumer, ms, seq, CASE WHEN x THEN {_DAY} ELSE delivered_ms END AS delivered_ms, CASE WHEN x THEN deliveries + 1 ELSE deliveries END AS deliveries FROM (SELECT *, consumer = 'c1' AND {_DAY} - delivered_ms >= 1000 AS x FROM stream_pel)")
def stream_xclaim(t: T) -> DataFrame:
    return streams.xclaim(t.stream_pel, t.stream_pel.where("consumer = 'c1'").select("key", "group", "ms", "seq"), "c9", 1000, _DAY)


@query(f"SELECT key, \"group\", ms, seq FROM stream_pel WHERE key = 'view' AND {_DAY} - delivered_ms >= 1000 ORDER BY ms, seq LIMIT 40")
def stream_xautoclaim(t: T) -> DataFrame:
    return streams.autoclaim_candidates(t.stream_pel, "view", "g", 1000, "0-0", _DAY, 40)


@query("SELECT * FROM stream_pel WHERE consumer <> 'c3'")
def stream_delconsumer(t: T) -> DataFrame:
    out = t.stream_pel
    for k in ("signup", "error", "click", "view", "purchase"):
        out = streams.del_consumer(out, k, "g", "c3")
    return out


def _created(t: T) -> DataFrame:
    none = t.rows([], "key string, `group` string, last_ms long, last_seq long")
    return streams.group_create(streams.group_create(none, t.stream_entries, "view", "new"), t.stream_entries, "click", "old", "5-1")


@query("SELECT 'view' AS key, 'new' AS \"group\", ms AS last_ms, seq AS last_seq FROM (SELECT * FROM stream_entries WHERE key = 'view' ORDER BY ms DESC, seq DESC LIMIT 1) UNION ALL SELECT 'click', 'old', 5, 1")
def stream_group_create(t: T) -> DataFrame:
    return _created(t)


@query("SELECT 'click' AS key, 'old' AS \"group\", 5 AS last_ms, 1 AS last_seq, (SELECT count(*) FROM stream_pel WHERE key <> 'view') AS pending")
def stream_group_destroy(t: T) -> DataFrame:
    pel = t.stream_pel.withColumn("group", F.when(F.col("key") == "view", "new").otherwise("old"))
    groups, left = streams.group_destroy(_created(t), pel, "view", "new")
    return groups.crossJoin(left.agg(F.count("*").alias("pending")))  # one row


# --- sketches and statistics


@query()
def hll_pfcount(t: T) -> DataFrame:
    s = sketches.pfadd(t.rows([], "key string, sketch binary"), t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("element")))
    return sketches.pfcount(s, ["click", "view"])


@query("SELECT key, CASE key WHEN 'both' THEN true ELSE false END AS merged FROM (SELECT DISTINCT o_orderpriority AS key FROM orders UNION ALL SELECT 'both')")
def hll_pfmerge(t: T) -> DataFrame:
    new = t.orders.select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("element"))
    s = sketches.pfmerge(sketches.pfadd(t.rows([], "key string, sketch binary"), new), "both", ["1-URGENT", "2-HIGH"])
    n = F.hll_sketch_estimate("sketch")
    both = t.orders.where("o_orderpriority in ('1-URGENT', '2-HIGH')").agg(F.countDistinct("o_custkey").alias("true"))
    return s.crossJoin(both).select("key", ((F.col("key") == "both") & (F.abs(n - F.col("true")) <= 0.05 * F.col("true"))).alias("merged"))  # one row


@query("SELECT true AS near")
def hll_within_bounds(t: T) -> DataFrame:
    new = t.orders.select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("element"))
    s = sketches.pfmerge(sketches.pfadd(t.rows([], "key string, sketch binary"), new), "all", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    exact = t.orders.agg(F.countDistinct("o_custkey").alias("x"))
    return sketches.pfcount(s, ["all"]).crossJoin(exact).select((F.abs(F.col("n") - F.col("x")) <= 0.03 * F.col("x")).alias("near"))  # one row each


@query("SELECT true AS bounds")
def sketch_count_min(t: T) -> DataFrame:
    e = t.events.select(F.col("user_id").cast("string").alias("user"))
    got = sketches.count_min_estimate(sketches.count_min(e, "user"), e.distinct(), "user")
    exact = e.groupBy("user").agg(F.count("*").alias("x"))
    return got.join(exact, "user").agg(F.min(F.col("estimate") >= F.col("x")).alias("bounds"))


@query("SELECT event_type AS command, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def stats_latency(t: T) -> DataFrame:
    return stats.latency_exact(t.events.select(F.col("event_type").alias("command"), F.col("value").alias("duration")), [50, 99])


@query()
def stats_latency_approx(t: T) -> DataFrame:
    return stats.latency(t.events.select(F.col("event_type").alias("command"), F.col("value").alias("duration")), [50, 99, 99.9])


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def stats_hotkeys(t: T) -> DataFrame:
    return stats.hot_keys(t.events.select(F.col("user_id").alias("key")), 10)


@query(", s AS (SELECT p_name AS key, p_size AS b FROM part) SELECT p AS prefix, CAST(coalesce((SELECT sum(b) FROM s WHERE starts_with(key, p)), 0) AS BIGINT) AS bytes FROM (VALUES ('a'), ('s'), ('zz')) v(p)")
def stats_memory(t: T) -> DataFrame:
    return stats.memory(t.part.select(F.col("p_name").alias("key"), F.col("p_size").alias("bytes")), ["a", "s", "zz"])


@query("SELECT substr(p_name, 1, 2) AS prefix, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY 1 ORDER BY bytes DESC, prefix LIMIT 5")
def stats_top_prefixes(t: T) -> DataFrame:
    return stats.top_prefixes(t.part.select(F.col("p_name").alias("key"), F.col("p_size").alias("bytes")), 2, 5)


# --- bitmaps

_BM = "bm AS (SELECT key, \"offset\" // 8 AS byte, CAST(bit_or(CAST(128 >> CAST(\"offset\" % 8 AS INT) AS INT)) AS INT) AS bits FROM bits GROUP BY 1, 2)"


def _bm(t: T) -> DataFrame:
    return bitmaps.from_offsets(t.bits)


@query("SELECT key, count(*) AS n FROM bits GROUP BY key")
def bitmap_bitcount(t: T) -> DataFrame:
    return bitmaps.bitcount(_bm(t))


@query("SELECT key, count(*) AS n FROM bits WHERE \"offset\" BETWEEN 13 AND 90 GROUP BY key")
def bitmap_bitcount_bits(t: T) -> DataFrame:
    return bitmaps.bitcount(_bm(t), 13, 90, bits=True)


@query(", q AS (SELECT c_custkey AS pos, 'click' AS key, c_custkey AS \"offset\" FROM customer) SELECT pos, key, \"offset\", CASE WHEN EXISTS (FROM bits b WHERE b.key = q.key AND b.\"offset\" = q.\"offset\") THEN 1 ELSE 0 END AS bit FROM q")
def bitmap_getbit(t: T) -> DataFrame:
    return bitmaps.getbit(_bm(t), t.customer.select(F.col("c_custkey").alias("pos"), F.lit("click").alias("key"), F.col("c_custkey").alias("offset")))


@query(f", {_BM} SELECT key, byte, bits FROM bm WHERE key <> 'click' OR byte <> 500 UNION ALL SELECT 'click', 500, 8")
def bitmap_setbit(t: T) -> DataFrame:
    return bitmaps.setbit(_bm(t), "click", 4004, True)


def _bitop_sql(op: str, having: str = "") -> str:
    return f", {_BM} SELECT 'dest' AS key, byte, CAST({op}(bits) AS INT) AS bits FROM bm WHERE key IN ('click', 'view') GROUP BY byte HAVING {op}(bits) <> 0 {having}"


@query(_bitop_sql("bit_and", "AND count(*) = 2"))
def bitmap_bitop_and(t: T) -> DataFrame:
    return bitmaps.bitop(_bm(t), "AND", "dest", ["click", "view"])


@query(_bitop_sql("bit_or"))
def bitmap_bitop_or(t: T) -> DataFrame:
    return bitmaps.bitop(_bm(t), "OR", "dest", ["click", "view"])


@query(f", b AS (SELECT DISTINCT event_type AS key, user_id * 7 + event_id % 5 AS o FROM events), {_BM.replace('FROM bits', 'FROM (SELECT key, o AS {}offset{} FROM b)'.format(chr(34), chr(34)))} SELECT 'dest' AS key, byte, CAST(bit_xor(bits) AS INT) AS bits FROM bm WHERE key IN ('click', 'view') GROUP BY byte HAVING bit_xor(bits) <> 0")
def bitmap_bitop_xor(t: T) -> DataFrame:
    spread = t.events.select(F.col("event_type").alias("key"), (F.col("user_id") * 7 + F.col("event_id") % 5).alias("offset")).distinct()
    return bitmaps.bitop(bitmaps.from_offsets(spread), "XOR", "dest", ["click", "view"])


@query(f", {_BM}, x AS (SELECT unnest(range(0, (SELECT max(byte) + 1 FROM bm WHERE key = 'click'))) AS byte) SELECT 'dest' AS key, byte, xor(255, coalesce(bits, 0)) AS bits FROM x LEFT JOIN (FROM bm WHERE key = 'click') USING (byte) WHERE coalesce(bits, 0) <> 255")
def bitmap_bitop_not(t: T) -> DataFrame:
    return bitmaps.bitop(_bm(t), "NOT", "dest", ["click"])


def _lengths(t: T) -> DataFrame:
    return t.bits.groupBy("key").agg((F.floor(F.max("offset") / 8) + 1).alias("n"))


@query("SELECT key, coalesce(min(\"offset\") FILTER (\"offset\" >= 24), -1) AS pos FROM bits GROUP BY key")
def bitmap_bitpos_one(t: T) -> DataFrame:
    return bitmaps.bitpos(_bm(t), _lengths(t), 1, 3)


@query(", l AS (SELECT key, (max(\"offset\") // 8 + 1) * 8 AS m FROM bits GROUP BY key) SELECT key, coalesce((SELECT min(i) FROM range(0, m) r(i) WHERE NOT EXISTS (FROM bits b WHERE b.key = l.key AND b.\"offset\" = i)), m) AS pos FROM l")
def bitmap_bitpos_zero(t: T) -> DataFrame:
    return bitmaps.bitpos(_bm(t), _lengths(t), 0)


@query("SELECT c_custkey AS id, c_custkey % 256 AS u8, CASE WHEN (c_custkey // 16) % 16 > 7 THEN (c_custkey // 16) % 16 - 16 ELSE (c_custkey // 16) % 16 END AS i4, (c_custkey % 256 + 200) % 256 AS wrap, least(c_custkey % 256 + 200, 255) AS sat, CASE WHEN c_custkey % 256 + 200 <= 255 THEN c_custkey % 256 + 200 END AS fail FROM customer")
def bitmap_bitfield(t: T) -> DataFrame:
    b = F.unhex(F.lpad(F.hex(F.col("c_custkey") % 256), 2, "0"))
    u8, i4 = bitmaps.Field.parse("u8", "0"), bitmaps.Field.parse("i4", "#0")
    incr = {o.lower(): bitmaps.field_incr(b, u8, 200, o) for o in ("WRAP", "SAT", "FAIL")}
    return t.customer.select(F.col("c_custkey").alias("id"), bitmaps.field_get(b, u8).alias("u8"), bitmaps.field_get(b, i4).alias("i4"), *[c.alias(k) for k, c in incr.items()])


@query("SELECT c_custkey AS id, c_custkey % 32 AS got FROM customer")
def bitmap_bitfield_set(t: T) -> DataFrame:
    f = bitmaps.Field.parse("u5", "11")
    made = bitmaps.field_set(F.lit(b"\xff\xff\xff"), f, F.col("c_custkey"))
    return t.customer.select(F.col("c_custkey").alias("id"), bitmaps.field_get(made, f).alias("got"))


# --- positions

_R = 6372797.560856


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * {_R} * asin(least(1.0, sqrt(pow(sin((radians({d}) - radians({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin((radians({c}) - radians({a})) / 2), 2)))))"


@query(f"SELECT a.key, a.member AS a, b.member AS b, round({_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} / 1000, 4) AS dist FROM geo a JOIN geo b ON a.key = b.key AND b.member = (SELECT min(member) FROM geo g WHERE g.key = a.key)")
def geo_geodist(t: T) -> DataFrame:
    first = t.geo.groupBy("key").agg(F.min("member").alias("b"))
    return geo.geodist(t.geo, t.geo.select("key", F.col("member").alias("a")).join(first, "key"), "km")


@query(f"SELECT key, member, round({_hav('10.0', '50.0', 'lon', 'lat')} / 1000, 4) AS dist FROM geo WHERE {_hav('10.0', '50.0', 'lon', 'lat')} <= 2000000")
def geo_geosearch(t: T) -> DataFrame:
    return geo.geosearch(t.geo, 10.0, 50.0, 2000, "km").select("key", "member", "dist")


@query(f", c AS (SELECT * FROM geo WHERE member = 'Customer#000000001') SELECT g.key, g.member, round({_hav('c.lon', 'c.lat', 'g.lon', 'g.lat')} / 1609.34, 4) AS dist FROM geo g JOIN c USING (key) ORDER BY dist, g.member LIMIT 10")
def geo_geosearch_member(t: T) -> DataFrame:
    key = t.geo.where("member = 'Customer#000000001'").first()["key"]
    return geo.geosearch_member(t.geo, key, "Customer#000000001", 20000, "mi", count=10).select("key", "member", "dist")


@query("SELECT pos, key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM (SELECT c_custkey AS pos, 'BUILDING' AS key, c_name AS member FROM customer) q LEFT JOIN geo USING (key, member)")
def geo_geopos(t: T) -> DataFrame:
    return geo.geopos(t.geo, t.customer.select(F.col("c_custkey").alias("pos"), F.lit("BUILDING").alias("key"), F.col("c_name").alias("member")))


@query("SELECT key, member, lon, lat FROM geo WHERE key <> 'BUILDING' UNION ALL SELECT 'BUILDING', member, 1.0, 2.0 FROM geo WHERE key = 'BUILDING'")
def geo_geoadd_xx(t: T) -> DataFrame:
    return geo.geoadd(t.geo, t.geo.select(F.lit("BUILDING").alias("key"), "member", F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")), "XX")


_BITS = "CAST(list_sum(list_transform(range(0, 26), lambda i: ((({x} >> (25 - i)) & 1) << (2 * (25 - i) + 1)) + ((({y} >> (25 - i)) & 1) << (2 * (25 - i))))) AS BIGINT)"
_GRID = "CAST(least(floor(({c} + {w}) / {s} * 67108864), 67108863) AS BIGINT)"


@query(
    f", g AS (SELECT key, member, {_GRID.format(c='lon', w='180.0', s='360.0')} AS x, {_GRID.format(c='lat', w='85.05112878', s='170.10225756')} AS y, {_GRID.format(c='lat', w='90.0', s='180.0')} AS z FROM geo),"
    f" h AS (SELECT key, member, {_BITS.format(x='x', y='y')} AS hash, {_BITS.format(x='x', y='z')} << 3 AS v FROM g)"
    " SELECT key, member, array_to_string(list_transform(range(0, 11), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST((v >> (50 - 5 * i)) & 31 AS INT) + 1, 1)), '') AS geohash, hash FROM h"
)
def geo_geohash(t: T) -> DataFrame:
    return t.geo.select("key", "member", geo.geohash(F.col("lon"), F.col("lat")).alias("geohash"), geo.geohash_int(F.col("lon"), F.col("lat")).alias("hash"))


@query(f"SELECT a.member AS l, b.member AS r, {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS dist FROM geo a, geo b WHERE a.key = 'BUILDING' AND b.key = 'MACHINERY' AND {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 300000")
def geo_radius_join(t: T) -> DataFrame:
    return geo.radius_join(t.geo.where("key = 'BUILDING'"), t.geo.where("key = 'MACHINERY'"), 300_000)


# --- vectors


def _knn_sql(f: str, k: int = 10) -> str:
    return f", v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings), q AS (SELECT e AS x FROM v ORDER BY id LIMIT 1) SELECT id, round({f}, 6) + 0.0 AS distance FROM v, q ORDER BY {f}, id LIMIT {k}"


def _first(t: T) -> list[float]:
    return t.vectors.orderBy("id").first()["vec"]


@query(_knn_sql("array_distance(e, x)"))
def vector_knn_l2(t: T) -> DataFrame:
    return vectors.knn(t.vectors, _first(t), 10).withColumn("distance", F.round("distance", 6) + 0.0)


@query(_knn_sql("array_cosine_distance(e, x)"))
def vector_knn_cosine(t: T) -> DataFrame:
    return vectors.knn(t.vectors, _first(t), 10, "cosine").withColumn("distance", F.round("distance", 6) + 0.0)


@query(_knn_sql("array_negative_inner_product(e, x)"))
def vector_knn_ip(t: T) -> DataFrame:
    return vectors.knn(t.vectors, _first(t), 10, "ip").withColumn("distance", F.round("distance", 6) + 0.0)


@query(", v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings) SELECT q.id AS qid, v.id, array_distance(v.e, q.e) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY array_distance(v.e, q.e), v.id) AS rank FROM v, v q WHERE q.id % 50 = 0 QUALIFY rank <= 5")
def vector_knn_join(t: T) -> DataFrame:
    return vectors.knn_join(t.vectors, t.vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), 5)


@query("SELECT count(*) + 1 AS n FROM embeddings")
def vector_vecset(t: T) -> DataFrame:
    new = t.rows([("main", [0.5] * 64), ("main", [0.5] * 64)], "index string, vec array<float>")
    return vectors.vecset(t.vectors, new).agg(F.count("*").alias("n"))


@query("SELECT 0 AS n")
def vector_vecdel(t: T) -> DataFrame:
    return vectors.vecdel(t.vectors, "main").agg(F.count("*").alias("n"))


_KNN5 = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings), k AS (SELECT q.id AS qid, v.id, array_distance(v.e, q.e) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY array_distance(v.e, q.e), v.id) AS rank FROM v, v q WHERE q.id % 50 = 0 QUALIFY rank <= 5)"


def _asked(t: T) -> DataFrame:
    return t.vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")


@query(f", {_KNN5} SELECT * FROM k")
def vector_cells(t: T) -> DataFrame:
    """All cells probed: the exact way through the index."""
    return vectors.CellIndex(t.vectors).join(_asked(t), 5, 16)


@query("SELECT true AS enough, count(*) * 5 AS wanted FROM embeddings WHERE vec_id % 50 = 0")
def vector_cells_recall(t: T) -> DataFrame:
    """At the default setting, against all vectors."""
    truth = vectors.knn_join(t.vectors, _asked(t), 5)
    found = vectors.CellIndex(t.vectors).join(_asked(t), 5)
    return vectors.recall(found, truth).select((F.col("recall") >= 0.9).alias("enough")).crossJoin(truth.agg(F.count("*").alias("wanted")))  # one row each
