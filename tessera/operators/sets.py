"""Sets: a table set_members(key, member) of distinct rows. Algebra over named sets is one grouped pass, not a chain of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.hashes import random_rows
from tessera.operators.order import lookup


def sadd(members: DataFrame, new: DataFrame) -> DataFrame:
    return members.unionByName(new.distinct().join(members, ["key", "member"], "left_anti"))


def sadd_count(members: DataFrame, new: DataFrame) -> DataFrame:
    """(key, added): members that weren't there."""
    return new.distinct().join(members, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def srem(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["key", "member"], "left_anti")


def smembers(members: DataFrame, key: str) -> DataFrame:
    return members.where(F.col("key") == key).select("member")


def smismember(members: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, member, present) of each request. Also SISMEMBER."""
    there = members.select("key", "member", F.lit(1).alias("there"))
    return lookup(req, there, "key", "member").select("pos", "key", "member", F.coalesce("there", F.lit(0)).cast("long").alias("present"))


def scard(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.count("*").alias("cardinality"))


def _of(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.where(F.col("key").isin(keys))


def sunion(members: DataFrame, keys: list[str]) -> DataFrame:
    return _of(members, keys).select("member").distinct()


def sinter(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of all the sets; a missing key is the empty set."""
    want = len(set(keys))
    return _of(members, keys).groupBy("member").agg(F.count("*").alias("n")).where(F.col("n") == want).select("member")


def sdiff(members: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first set and of none of the others."""
    first, rest = keys[0], keys[1:]
    if first in rest:
        return members.select("member").limit(0)
    g = _of(members, keys).groupBy("member").agg(F.count("*").alias("n"), F.max(F.col("key") == first).alias("in_first"))
    return g.where((F.col("n") == 1) & F.col("in_first")).select("member")


def store(members: DataFrame, destination: str, result: DataFrame) -> DataFrame:
    """The table with `destination` replaced by a result (member); an empty result removes it. SUNIONSTORE, SINTERSTORE, SDIFFSTORE."""
    return members.where(F.col("key") != destination).unionByName(result.select(F.lit(destination).alias("key"), "member"))


def sintercard(members: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    """(n): the size of the intersection, at most `limit` unless that is 0."""
    found = sinter(members, keys)
    return (found.limit(limit) if limit else found).agg(F.count("*").alias("n"))


def smove(members: DataFrame, source: str, destination: str, member: str) -> DataFrame:
    there = members.where((F.col("key") == source) & (F.col("member") == member))
    rest = members.where(~((F.col("key") == source) & (F.col("member") == member)))
    return rest.unionByName(there.withColumn("key", F.lit(destination)).join(members, ["key", "member"], "left_anti"))


def random_members(members: DataFrame, key: str, count: int = 1, seed: int = 0) -> DataFrame:
    """SRANDMEMBER: count distinct members in a seeded order, or -count draws with repeats."""
    return random_rows(smembers(members, key), "member", count, seed)


def spop(members: DataFrame, key: str, count: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped, rest)."""
    out = random_members(members, key, max(0, count), seed)
    return out, srem(members, out.withColumn("key", F.lit(key)))
