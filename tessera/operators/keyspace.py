"""The string keyspace: a table kv(key STRING, value BINARY, expire_at TIMESTAMP). Each operator is a transform of tables; `now` is an argument, so results repeat.

Batch arguments are tables, too: req(pos, key) of positional lookups, new(key, value[, expire_at][, pos]) of writes. Writes return the whole new table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.text import byte_range, float_text, glob, integer, overlay_bytes
from tessera.operators.order import lookup, wanted


def is_live(now: datetime) -> Column:
    return F.col("expire_at").isNull() | (F.col("expire_at") > F.lit(now))


def live(kv: DataFrame, now: datetime) -> DataFrame:
    """Rows that haven't expired."""
    return kv.where(is_live(now))


def _expiry(df: DataFrame) -> DataFrame:
    return df if "expire_at" in df.columns else df.withColumn("expire_at", F.lit(None).cast("timestamp"))


def last_wins(new: DataFrame) -> DataFrame:
    """One row for each key: that of the highest pos, if there is one."""
    if "pos" not in new.columns:
        return new.dropDuplicates(["key"])
    rest = [c for c in new.columns if c not in ("key", "pos")]
    return new.groupBy("key").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, new: DataFrame, *on: str) -> DataFrame:
    """`new` over `table` by key columns: one anti join, no read-modify-write."""
    return table.join(new, list(on), "left_anti").unionByName(new.select(*table.columns))


# --- reads


def get(kv: DataFrame, key: str, now: datetime) -> DataFrame:
    """value of a key: no row if it is absent or expired. The equality reaches the scan."""
    return live(kv.where(F.col("key") == key), now).select("value")


def mget(kv: DataFrame, req: DataFrame, now: datetime) -> DataFrame:
    """(pos, key, value) for each request, null where there is none; repeated keys answer each time."""
    return lookup(req, live(kv, now).select("key", "value"), "key").select("pos", "key", "value")


def strlen(kv: DataFrame, now: datetime) -> DataFrame:
    return live(kv, now).select("key", F.octet_length("value").cast("long").alias("length"))


def getrange(kv: DataFrame, start: int, stop: int, now: datetime) -> DataFrame:
    return live(kv, now).select("key", byte_range(F.col("value"), start, stop).alias("value"))


def exists(kv: DataFrame, req: DataFrame, now: datetime) -> DataFrame:
    """(n): requests whose key is live, a repeated request counted each time. Also TOUCH."""
    return req.join(wanted(live(kv, now).select("key"), req, "key"), "key", "left_semi").agg(F.count("*").alias("n"))


def ttl(kv: DataFrame, req: DataFrame, now: datetime, millis: bool = False) -> DataFrame:
    """(pos, key, ttl): -2 without the key, -1 without an expiry, else what is left in whole seconds or in milliseconds."""
    left = F.unix_micros("expire_at") - F.unix_micros(F.lit(now).cast("timestamp"))
    left = F.floor(left / (1000 if millis else 1_000_000)).cast("long")
    found = live(kv, now).select("key", F.when(F.col("expire_at").isNull(), F.lit(-1).cast("long")).otherwise(left).alias("ttl"))
    return lookup(req, found, "key").select("pos", "key", F.coalesce("ttl", F.lit(-2).cast("long")).alias("ttl"))


def keys(kv: DataFrame, pattern: str, now: datetime) -> DataFrame:
    return live(kv, now).where(glob(F.col("key"), pattern)).select("key")


def scan(kv: DataFrame, cursor: int, now: datetime, pattern: str = "*", count: int = 10) -> DataFrame:
    """(key, next): the page of sorted matching keys at offset `cursor`, and the next cursor, 0 at the end. A later page is found by offset, so each costs a top-k of cursor + count keys."""
    page = keys(kv, pattern, now).orderBy("key").offset(cursor).limit(count + 1)
    w = Window.partitionBy()  # at most count + 1 rows
    page = page.withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("key")))
    return page.where(F.col("rn") <= count).select("key", F.when(F.col("n") > count, cursor + count).otherwise(0).cast("long").alias("next"))


def dbsize(kv: DataFrame) -> DataFrame:
    """Entries, expired ones that weren't swept yet among them."""
    return kv.agg(F.count("*").alias("n"))


def randomkey(kv: DataFrame, now: datetime, seed: int = 0) -> DataFrame:
    return live(kv, now).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(1).select("key")


def object_encoding(kv: DataFrame, now: datetime) -> DataFrame:
    """int for the decimal text of a 64-bit integer, as counters leave it, embstr up to 23 bytes, else raw."""
    return live(kv, now).select("key", F.when(integer(F.col("value")).isNotNull(), "int").when(F.octet_length("value") <= 23, "embstr").otherwise("raw").alias("encoding"))


def object_info(kv: DataFrame, now: datetime) -> DataFrame:
    """(key, refcount, idletime): constants of a live key."""
    return live(kv, now).select("key", F.lit(1).cast("long").alias("refcount"), F.lit(0).cast("long").alias("idletime"))


def object_freq(kv: DataFrame, accesses: DataFrame, now: datetime) -> DataFrame:
    """(key, freq): a logarithmic counter that starts at 5, from an access log. Its expected growth: c accesses lift it by about sqrt(c / 5)."""
    n = accesses.groupBy("key").agg(F.count("*").alias("c"))
    return live(kv, now).join(n, "key", "left").select("key", (5 + F.floor(F.sqrt(F.coalesce("c", F.lit(0)) / 5))).cast("long").alias("freq"))


def type_of(tables: dict[str, DataFrame], req: DataFrame) -> DataFrame:
    """(pos, key, type): the kind of table that holds each key, `none` where none does."""
    held = None
    for name, df in tables.items():
        one = wanted(df.select("key"), req, "key").distinct().withColumn("type", F.lit(name))
        held = one if held is None else held.unionByName(one)
    first = held.groupBy("key").agg(F.min("type").alias("type"))
    return req.join(first, "key", "left").select("pos", "key", F.coalesce("type", F.lit("none")).alias("type"))


# --- writes: each returns the new table


def set_(kv: DataFrame, new: DataFrame, now: datetime, mode: str | None = None) -> DataFrame:
    """Upsert; NX only absent keys, XX only present ones; an expired key is absent. An old expiry goes."""
    new = last_wins(_expiry(new))
    there = live(kv, now).select("key")
    if mode:
        new = new.join(there, "key", {"NX": "left_anti", "XX": "left_semi"}[mode])
    return upsert(kv, new, "key")


def setnx(kv: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """(key, set): 1 where the key was absent and so is written."""
    there = live(kv, now).select("key", F.lit(1).alias("there"))
    return lookup(last_wins(new), there, "key").select("key", F.when(F.col("there").isNull(), 1).otherwise(0).cast("long").alias("set"))


def msetnx(kv: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """All of `new`, or nothing if any of its keys is present."""
    taken = new.join(live(kv, now), "key", "left_semi").agg(F.count("*").alias("taken"))
    allowed = _expiry(last_wins(new)).join(F.broadcast(taken), F.col("taken") == 0).drop("taken")  # one row
    return upsert(kv, allowed, "key")


def getset(kv: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """(key, old): the values that `new` replaces."""
    return lookup(last_wins(new).select("key"), live(kv, now).select("key", F.col("value").alias("old")), "key")


def append(kv: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Bytes of `new` after the stored ones; a missing key is made; the expiry stays."""
    old = live(kv, now)
    grown = new.select("key", F.col("value").alias("more")).transform(lookup, old, "key").select("key", F.concat(F.coalesce("value", F.lit(b"")), "more").alias("value"), "expire_at")
    return upsert(kv, grown, "key")


def setrange(kv: DataFrame, offset: int, value: bytes, now: datetime) -> DataFrame:
    """Every live value with bytes overwritten at an offset."""
    return live(kv, now).select("key", overlay_bytes(F.col("value"), offset, value).alias("value"), "expire_at")


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def incrby(kv: DataFrame, deltas: DataFrame, now: datetime) -> DataFrame:
    """(key, value BIGINT) after adding the deltas (key, delta), those of one key summed first. A value that is no integer, or an overflow, is an error. Also INCR, DECR, DECRBY."""
    total = deltas.groupBy("key").agg(F.try_sum("delta").alias("delta"), F.count("*").alias("asked"))
    joined = lookup(total, live(kv, now).select("key", F.col("value").alias("old")), "key")
    base = F.when(F.col("old").isNull(), F.lit(0).cast("bigint")).otherwise(integer(F.col("old")))
    base = _checked(base, base.isNotNull(), "ERR value is not an integer or out of range")
    out = F.try_add(base, F.col("delta"))
    return joined.select("key", _checked(out, out.isNotNull(), "ERR increment or decrement would overflow").alias("value"))


def incrbyfloat(kv: DataFrame, deltas: DataFrame, now: datetime) -> DataFrame:
    """(key, value STRING): sums as shortest text; NaN and infinities are errors."""
    total = deltas.groupBy("key").agg(F.sum(F.col("delta").cast("double")).alias("delta"))
    joined = lookup(total, live(kv, now).select("key", F.col("value").cast("string").alias("old")), "key")
    base = F.when(F.col("old").isNull(), F.lit(0.0)).otherwise(F.col("old").try_cast("double"))
    out = _checked(base, base.isNotNull(), "ERR value is not a valid float") + F.col("delta")
    return joined.select("key", float_text(_checked(out, ~F.isnan(out) & (F.abs(out) < float("inf")), "ERR increment would produce NaN or Infinity")).alias("value"))


def store_text(kv: DataFrame, made: DataFrame) -> DataFrame:
    """Results (key, value) of a counter written back with their keys' expiries."""
    new = made.select("key", F.col("value").cast("string").cast("binary").alias("value")).transform(lookup, kv.select("key", "expire_at"), "key")
    return upsert(kv, new, "key")


def delete(kv: DataFrame, req: DataFrame) -> DataFrame:
    """kv without the requested keys. Also UNLINK and the second half of GETDEL."""
    return kv.join(req, "key", "left_anti")


def deleted(kv: DataFrame, req: DataFrame) -> DataFrame:
    """(n): how many keys a delete removes, expired ones that weren't swept among them."""
    return kv.join(req, "key", "left_semi").agg(F.count("*").alias("n"))


def getdel(kv: DataFrame, req: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(answers, rest): what MGET answers, and kv without the requested keys."""
    return mget(kv, req, now), delete(kv, req)


def getex(kv: DataFrame, at: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(answers, kv): the values of the keys of at(pos, key, expire_at), and kv with their new expiries; a null one removes the expiry."""
    kept = persist(kv, at.where("expire_at is null"), now)
    return mget(kv, at, now), expire(kept, at.where("expire_at is not null").select("key", "expire_at"), now)


def expire(kv: DataFrame, at: DataFrame, now: datetime) -> DataFrame:
    """kv with the expiries of at(key, expire_at); a moment that has passed removes the key. Also PEXPIRE, EXPIREAT, PEXPIREAT, SETEX and GETEX's options."""
    moved = live(kv, now).join(at.withColumnRenamed("expire_at", "_at"), "key", "left").withColumn("_set", F.col("_at").isNotNull())
    out = moved.withColumn("expire_at", F.coalesce("_at", "expire_at")).where(~F.col("_set") | (F.col("_at") > F.lit(now)))
    return out.select(*kv.columns)


def persist(kv: DataFrame, req: DataFrame, now: datetime) -> DataFrame:
    """kv with the requested keys' expiries removed."""
    hit = req.select("key", F.lit(True).alias("_hit")).distinct()
    return live(kv, now).join(hit, "key", "left").withColumn("expire_at", F.when(F.col("_hit").isNull(), F.col("expire_at"))).select(*kv.columns)


def rename(kv: DataFrame, old: str, new: str, now: datetime, only_free: bool = False) -> DataFrame:
    """The entry and its expiry under a new key, over whatever was there; with only_free (RENAMENX) not over a live key."""
    there = live(kv, now).where(F.col("key") == old)
    if there.isEmpty():
        raise CommandError("ERR no such key")
    if only_free and not live(kv, now).where(F.col("key") == new).isEmpty():
        return kv
    return kv.where(~F.col("key").isin(old, new)).unionByName(there.withColumn("key", F.lit(new)))


def copy(kv: DataFrame, old: str, new: str, now: datetime, replace: bool = False) -> DataFrame:
    """A second entry with the same value and expiry; over a live key only with replace."""
    there = live(kv, now).where(F.col("key") == old).withColumn("key", F.lit(new))
    if not replace and not live(kv, now).where(F.col("key") == new).isEmpty():
        return kv
    return upsert(kv, there, "key")


def flush(kv: DataFrame) -> DataFrame:
    return kv.limit(0)


def evict(kv: DataFrame, accesses: DataFrame, n: int, now: datetime) -> DataFrame:
    """kv without the n least accessed keys (ties: least key first)."""
    least = object_freq(kv, accesses, now).orderBy("freq", "key").limit(n)
    return kv.join(least, "key", "left_anti")
