"""Lists: a table list_items(key, pos BIGINT, value). Positions order the items and may have gaps; ranks are made by windows within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.text import clamp_range
from tessera.operators.order import ranked


def _ranked(items: DataFrame) -> DataFrame:
    """Items with idx, from 0, and n, their list's length."""
    return ranked(items, "idx", "key", F.col("pos"), total="n")


def push(items: DataFrame, new: DataFrame, left: bool = False) -> DataFrame:
    """Items with new(key, ord, value) pushed in the order of ord: at the tail (RPUSH), or each before the head (LPUSH)."""
    ends = items.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rn = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    at = F.coalesce("lo", F.lit(0)) - rn if left else F.coalesce("hi", F.lit(-1)) + rn
    return items.unionByName(new.join(ends, "key", "left").select("key", at.cast("long").alias("pos"), "value"))


def length(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count("*").alias("length"))


def lrange(items: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, idx, value) of an inclusive range; bounds below the head become 0, so 0 .. -100 gives the first item."""
    a, b = clamp_range(F.col("n"), start, stop)
    return _ranked(items).where((F.col("idx") >= a) & (F.col("idx") <= b)).select("key", F.col("idx").cast("long").alias("idx"), "value")


def lindex(items: DataFrame, index: int) -> DataFrame:
    """(key, value) at an index; one below the head gives the head, one past the tail nothing."""
    at = F.greatest(F.col("n") + index, F.lit(0)) if index < 0 else F.lit(index)
    return _ranked(items).where(F.col("idx") == at).select("key", "value")


def lset(items: DataFrame, index: int, value: Column) -> DataFrame:
    """Items with the one at an index replaced; an index outside a list is an error."""
    r = _ranked(items)
    at = F.col("n") + index if index < 0 else F.lit(index)
    bad = (at < 0) | (at >= F.col("n"))
    return r.select("key", "pos", F.when(bad, F.raise_error(F.lit("ERR index out of range"))).when(F.col("idx") == at, value).otherwise(F.col("value")).alias("value"))


def linsert(items: DataFrame, pivot: Column, value: Column, before: bool = True) -> DataFrame:
    """Items with a value beside the first item equal to pivot of each list; lists without it stay. Positions are dealt anew."""
    hit = items.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    both = items.withColumn("half", F.lit(0)).unionByName(hit.select("key", "pos", value.alias("value"), F.lit(-1 if before else 1).alias("half")))
    return both.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("pos", "half")) - 1).cast("long").alias("pos"), "value")


def lrem(items: DataFrame, count: int, value: Column) -> DataFrame:
    """Items without `count` equal to value: from the head, from the tail if negative, all if 0."""
    if not count:
        return items.where(F.col("value") != value)
    order = F.col("pos").asc() if count > 0 else F.col("pos").desc()
    w = Window.partitionBy("key", "value").orderBy(order)
    return items.withColumn("rn", F.row_number().over(w)).where((F.col("value") != value) | (F.col("rn") > abs(count))).drop("rn")


def ltrim(items: DataFrame, start: int, stop: int) -> DataFrame:
    """Items of an inclusive range; a list with none is gone."""
    a, b = clamp_range(F.col("n"), start, stop)
    return _ranked(items).where((F.col("idx") >= a) & (F.col("idx") <= b)).select("key", "pos", "value")


def lpos(items: DataFrame, value: Column, rank: int = 1, count: int | None = 1, maxlen: int = 0) -> DataFrame:
    """(key, idx) of items equal to value: from the rank-th match on, from the tail if negative; `count` matches (0: all), among the first `maxlen` items looked at (0: all)."""
    if rank == 0:
        raise CommandError("ERR RANK can't be zero")
    r = _ranked(items)
    seen = F.col("idx") if rank > 0 else F.col("n") - 1 - F.col("idx")
    if maxlen:
        r = r.where(seen < maxlen)
    m = r.where(F.col("value") == value).withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy("idx" if rank > 0 else F.desc("idx"))))
    m = m.where(F.col("rn") >= abs(rank))
    if count:
        m = m.where(F.col("rn") < abs(rank) + count)
    return m.select("key", F.col("idx").cast("long").alias("idx"))


def pop(items: DataFrame, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): one item of each list, from its head or tail. There is no count."""
    rn = F.row_number().over(Window.partitionBy("key").orderBy("pos" if left else F.desc("pos")))
    r = items.withColumn("rn", rn)
    return r.where("rn = 1").select("key", "value"), r.where("rn > 1").drop("rn")


def lmove(items: DataFrame, source: str, destination: str, from_left: bool, to_left: bool) -> DataFrame:
    """Items with one moved between lists (RPOPLPUSH: right to left)."""
    moved, rest = pop(items.where(F.col("key") == source), from_left)
    kept = rest.unionByName(items.where(F.col("key") != source))
    return push(kept, moved.select(F.lit(destination).alias("key"), F.lit(0).alias("ord"), "value"), to_left)


def blocking_move(items: DataFrame, source: str, destination: str, from_left: bool, to_left: bool) -> DataFrame:
    """One try of BLMOVE over the lists as they are: an empty source leaves them so."""
    return lmove(items, source, destination, from_left, to_left)


def first_nonempty(items: DataFrame, req: DataFrame) -> DataFrame:
    """(key) of the first requested list with items, in request order: what a blocking pop takes from."""
    return req.join(items.select("key").distinct(), "key", "left_semi").orderBy("pos").limit(1).select("key")


def blocking_pop(items: DataFrame, req: DataFrame, left: bool = True) -> DataFrame:
    """(key, value): one try of BLPOP or BRPOP over the lists as they are. Waiting is the stream form."""
    return pop(items.join(first_nonempty(items, req), "key", "left_semi"), left)[0]

