"""Change capture: events cdc(seq, ts_ms, op, key, value) as batches and as streams, with cursors, gaps, patterns and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.text import glob
from tessera.operators.order import numbered

OPS = ("SET", "DEL", "EXPIRE", "HSET", "LPUSH", "RPUSH", "SADD", "FLUSHDB")
SCHEMA = "seq long, ts_ms long, op string, key string, value string"
IDLE_MS = 30_000


def changes(before: DataFrame, after: DataFrame, seq: int, ts_ms: int) -> DataFrame:
    """Events that turn one kv table into another: a SET for each new or changed key, a DEL for each that is gone, numbered by key."""
    o, n = before.select("key", F.col("value").alias("old")), after.select("key", F.col("value").alias("new"))
    j = o.join(n, "key", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    ops = j.select(F.when(F.col("new").isNull(), "DEL").otherwise("SET").alias("op"), "key", F.col("new").cast("string").alias("value"))
    return numbered(ops, "rn", F.col("key")).select((seq + F.col("rn")).cast("long").alias("seq"), F.lit(ts_ms).cast("long").alias("ts_ms"), "op", "key", "value")


def poll(events: DataFrame, cursor: int, count: int) -> DataFrame:
    """The next `count` events from a cursor on."""
    return events.where(F.col("seq") >= cursor).orderBy("seq").limit(count)


def poll_status(events: DataFrame, cursor: int, count: int) -> DataFrame:
    """(next, gap): the cursor after a poll, and whether events before the oldest kept one were missed."""
    page = poll(events, cursor, count).agg(F.max("seq").alias("m"))
    oldest = events.agg(F.min("seq").alias("lo"))
    return page.crossJoin(oldest).select(F.coalesce(F.col("m") + 1, F.lit(cursor)).cast("long").alias("next"), F.coalesce(F.col("lo") > cursor, F.lit(False)).alias("gap"))  # one row each


def matching(events: DataFrame, pattern: str) -> DataFrame:
    """Events of keys that match a glob, on a batch or a stream."""
    return events.where(glob(F.col("key"), pattern))


def keep_last(events: DataFrame, capacity: int) -> DataFrame:
    """The ring: the newest `capacity` events."""
    top = events.agg(F.max("seq").alias("top"))
    return events.join(F.broadcast(top), F.col("seq") > F.col("top") - capacity).drop("top")  # one row


def stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """Events as they are appended to a Parquet log. The query's checkpoint is the consumer's cursor."""
    r = spark.readStream.schema(SCHEMA)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(folder)


# --- groups: pel(group, consumer, seq, delivered_ms, deliveries), groups(group, next_seq)


def group_create(groups: DataFrame, group: str, start: int) -> DataFrame:
    """groups with one more, that reads from a sequence number on."""
    if not groups.where(F.col("group") == group).isEmpty():
        raise CommandError("BUSYGROUP Consumer Group name already exists")
    return groups.unionByName(groups.sparkSession.range(1).select(F.lit(group).alias("group"), F.lit(start).cast("long").alias("next_seq")))


def group_read(events: DataFrame, groups: DataFrame, pel: DataFrame, group: str, consumer: str, count: int, now_ms: int) -> DataFrame:
    """Events that a consumer gets: first those of others that were idle for 30 s, then new ones; redelivered is true for the first kind."""
    own = pel.where(F.col("group") == group)
    late = own.where((F.col("consumer") != consumer) & (now_ms - F.col("delivered_ms") >= IDLE_MS)).select("seq", F.lit(True).alias("redelivered"))
    start = groups.where(F.col("group") == group).select("next_seq")
    new = events.join(F.broadcast(start), F.col("seq") >= F.col("next_seq")).select("seq", F.lit(False).alias("redelivered"))  # one row
    page = late.unionByName(new).orderBy(F.desc("redelivered"), "seq").limit(count)
    return events.join(page, "seq").select("seq", "ts_ms", "op", "key", "value", "redelivered")


def group_deliver(groups: DataFrame, pel: DataFrame, delivered: DataFrame, group: str, consumer: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(groups, pel) after a delivery: a redelivered event moves to the consumer and counts 2."""
    moved = pel.join(delivered.select("seq", F.lit(group).alias("group")), ["seq", "group"], "left_anti")
    new = delivered.select(F.lit(group).alias("group"), F.lit(consumer).alias("consumer"), "seq", F.lit(now_ms).cast("long").alias("delivered_ms"), F.when(F.col("redelivered"), 2).otherwise(1).cast("long").alias("deliveries"))
    top = delivered.where(~F.col("redelivered")).agg((F.max("seq") + 1).alias("t"))
    ahead = groups.crossJoin(F.broadcast(top)).select("group", F.when(F.col("group") == group, F.greatest("next_seq", F.coalesce("t", "next_seq"))).otherwise(F.col("next_seq")).alias("next_seq"))  # one row
    return ahead, moved.unionByName(new.select(*pel.columns))


def ack(pel: DataFrame, done: DataFrame) -> DataFrame:
    """pel without the events of done(group, seq), whoever holds them."""
    return pel.join(done, ["group", "seq"], "left_anti")


def pending(pel: DataFrame, group: str, now_ms: int) -> DataFrame:
    """(seq, consumer, idle, deliveries) of a group."""
    return pel.where(F.col("group") == group).select("seq", "consumer", (now_ms - F.col("delivered_ms")).alias("idle"), "deliveries").orderBy("seq")


def claim(pel: DataFrame, group: str, consumer: str, seqs: list[int], min_idle: int, now_ms: int) -> DataFrame:
    """pel with idle events moved to a consumer and delivered once more."""
    take = (F.col("group") == group) & F.col("seq").isin(seqs) & (now_ms - F.col("delivered_ms") >= min_idle)
    return pel.withColumns({"consumer": F.when(take, consumer).otherwise(F.col("consumer")), "deliveries": F.when(take, F.col("deliveries") + 1).otherwise(F.col("deliveries")), "delivered_ms": F.when(take, now_ms).otherwise(F.col("delivered_ms"))})
