"""Hashes: a table hash_fields(key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import float_text, glob, integer
from tessera.operators.keyspace import upsert
from tessera.operators.order import lookup, numbered


def hset(fields: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of new(key, field, value[, pos]); of a repeated field the highest pos wins. Also HMSET."""
    if "pos" in new.columns:
        new = new.groupBy("key", "field").agg(F.max_by("value", "pos").alias("value"))
    return upsert(fields, new.dropDuplicates(["key", "field"]), "key", "field")


def hset_added(fields: DataFrame, new: DataFrame) -> DataFrame:
    """(key, added): how many of the written fields are new."""
    return new.select("key", "field").distinct().join(fields, ["key", "field"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def hsetnx(fields: DataFrame, new: DataFrame) -> DataFrame:
    return fields.unionByName(new.join(fields, ["key", "field"], "left_anti").select(*fields.columns))


def hget(fields: DataFrame, key: str, field: str) -> DataFrame:
    return fields.where((F.col("key") == key) & (F.col("field") == field)).select("value")


def hmget(fields: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, field, value) for each request (pos, key, field), null where there is none."""
    return lookup(req, fields, "key", "field").select("pos", "key", "field", "value")


def hdel(fields: DataFrame, req: DataFrame) -> DataFrame:
    return fields.join(req, ["key", "field"], "left_anti")


def hgetall(fields: DataFrame, key: str) -> DataFrame:
    """(field, value) of a hash."""
    return fields.where(F.col("key") == key).select("field", "value")


def hkeys(fields: DataFrame, key: str) -> DataFrame:
    return hgetall(fields, key).select("field")


def hvals(fields: DataFrame, key: str) -> DataFrame:
    return hgetall(fields, key).select("value")


def hlen(fields: DataFrame) -> DataFrame:
    return fields.groupBy("key").agg(F.count("*").alias("length"))


def hexists(fields: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, field, present) of each request."""
    there = fields.select("key", "field", F.lit(1).alias("there"))
    return lookup(req, there, "key", "field").select("pos", "key", "field", F.coalesce("there", F.lit(0)).cast("long").alias("present"))


def hincrby(fields: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, field, value BIGINT) after adding deltas (key, field, delta)."""
    total = deltas.groupBy("key", "field").agg(F.try_sum("delta").alias("delta"))
    j = lookup(total, fields, "key", "field")
    base = F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(integer(F.col("value")))
    base = F.when(base.isNull(), F.raise_error(F.lit("ERR hash value is not an integer"))).otherwise(base)
    out = F.try_add(base, F.col("delta"))
    return j.select("key", "field", F.when(out.isNull(), F.raise_error(F.lit("ERR increment or decrement would overflow"))).otherwise(out).alias("value"))


def hincrbyfloat(fields: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, field, value STRING) after adding doubles."""
    total = deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast("double")).alias("delta"))
    j = lookup(total, fields, "key", "field")
    base = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.col("value").cast("string").try_cast("double"))
    out = F.when(base.isNull(), F.raise_error(F.lit("ERR hash value is not a float"))).otherwise(base) + F.col("delta")
    return j.select("key", "field", float_text(out).alias("value"))


def random_fields(fields: DataFrame, key: str, count: int = 1, seed: int = 0) -> DataFrame:
    """count distinct fields in a seeded order, or, if negative, that many draws with repeats."""
    return random_rows(fields.where(F.col("key") == key).select("field", "value"), "field", count, seed)


def random_rows(rows: DataFrame, by: str, count: int, seed: int) -> DataFrame:
    if count >= 0:
        return rows.orderBy(F.xxhash64(by, F.lit(seed)), by).limit(count)
    n = rows.count()
    if not n:
        return rows
    draws = rows.sparkSession.range(-count).select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))).alias("rn"))
    return draws.join(numbered(rows, "rn", F.xxhash64(by, F.lit(seed)), by), "rn").orderBy("id").drop("id", "rn")


def page(rows: DataFrame, by: str, cursor: int, pattern: str = "*", count: int = 10) -> DataFrame:
    """The page at offset `cursor` of rows sorted by a column and matching a glob. HSCAN, SSCAN and ZSCAN."""
    return rows.where(glob(F.col(by), pattern)).orderBy(by).offset(cursor).limit(count)
