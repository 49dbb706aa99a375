"""Sorted sets: a table zset(key, member, score DOUBLE). The order is score, then member bytes; a reverse order turns both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.text import clamp_range
from tessera.operators.hashes import random_rows
from tessera.operators.keyspace import upsert
from tessera.operators.order import lookup, ranked, size


#: Requests whose ranks are counted without sorting, and the size of a table of them that needs no count; ranks up to which a range keeps rows in the tasks that read them.
MAX_ASKED, ASKED_BYTES, FIRST_ROWS = 1000, 1 << 14, 100_000


def _order(reverse: bool) -> list[Column]:
    return [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]


def _rn(reverse: bool) -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse)))


def _ranked(z: DataFrame, reverse: bool) -> DataFrame:
    return ranked(z, "rank", "key", F.col("score"), F.col("member"), reverse=reverse, total="n")


def zadd(z: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of scores; of a repeated member the highest pos wins if there is one."""
    if "pos" in new.columns:
        new = new.groupBy("key", "member").agg(F.max_by("score", "pos").alias("score"))
    return upsert(z, new.dropDuplicates(["key", "member"]), "key", "member")


def zadd_count(z: DataFrame, new: DataFrame) -> DataFrame:
    return new.select("key", "member").distinct().join(z, ["key", "member"], "left_anti").groupBy("key").agg(F.count("*").alias("added"))


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone, ["key", "member"], "left_anti")


def zmscore(z: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, member, score) of each request, null where there is none. Also ZSCORE."""
    return lookup(req, z, "key", "member").select("pos", "key", "member", "score")


def zincrby(z: DataFrame, deltas: DataFrame) -> DataFrame:
    """(key, member, score) after adding deltas; a missing member starts at 0."""
    d = deltas.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    return lookup(d, z, "key", "member").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.col("delta")).alias("score"))


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("cardinality"))


def zrank(z: DataFrame, req: DataFrame | None = None, reverse: bool = False) -> DataFrame:
    """(key, member, rank) from 0. For few requests, rank is a count of what stands before, so no set is sorted; for many, sets are ranked once."""
    every = lambda: _ranked(z, reverse).select("key", "member", "rank")
    if req is None:
        return every()
    if size(req) > ASKED_BYTES and req.limit(MAX_ASKED + 1).count() > MAX_ASKED:
        return every().join(req.select("key", "member").distinct(), ["key", "member"])
    at = F.broadcast(z.join(F.broadcast(req.select("key", "member").distinct()), ["key", "member"]).select("key", F.col("member").alias("m"), F.col("score").alias("s")))  # as many rows as req
    before = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") > F.col("m"))) if reverse else (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < F.col("m")))
    return z.join(at, "key").groupBy("key", "m").agg(F.count_if(before).alias("rank")).withColumnRenamed("m", "member")


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """(key, member, score, rank) of an inclusive range of ranks; negative ranks count from the end."""
    if 0 <= start <= stop <= FIRST_ROWS:
        r = z.withColumn("rank", (_rn(reverse) - 1).cast("long"))
        return r.where(F.col("rank").between(start, stop)).select("key", "member", "score", "rank")  # a bounded window: Spark keeps the first rows of each task only
    r = _ranked(z, reverse)
    if start >= 0 and stop >= 0:
        return r.where(F.col("rank").between(start, stop)).select("key", "member", "score", "rank")
    a, b = clamp_range(F.col("n"), start, stop)
    return r.where((F.col("rank") >= a) & (F.col("rank") <= b)).select("key", "member", "score", "rank")


def parse_score(text: str) -> tuple[float, bool]:
    """(bound, exclusive): a number, inf, +inf or -inf; a leading ( excludes it, which is an extra of ours."""
    open_ = text.startswith("(")
    try:
        out = float(text[open_:])
    except ValueError:
        raise CommandError("ERR min or max is not a float") from None
    if math.isnan(out):
        raise CommandError("ERR min or max is not a float")
    return out, open_


def _in_scores(lo: str | float, hi: str | float) -> Column:
    (a, a_open), (b, b_open) = parse_score(str(lo)), parse_score(str(hi))
    s = F.col("score")
    return ((s > a) if a_open else (s >= a)) & ((s < b) if b_open else (s <= b))


def _page(rows: DataFrame, key: str | None, reverse: bool, offset: int, count: int | None) -> DataFrame:
    """Rows of one key in order with LIMIT as a top-k; of all keys, LIMIT within each."""
    if key is not None:
        rows = rows.where(F.col("key") == key).orderBy(*_order(reverse)).offset(offset)
        return rows if count is None or count < 0 else rows.limit(count)
    if offset or (count is not None and count >= 0):
        rows = rows.withColumn("_rn", _rn(reverse)).where(F.col("_rn") > offset)
        rows = (rows if count is None or count < 0 else rows.where(F.col("_rn") <= offset + count)).drop("_rn")
    return rows


def zrangebyscore(z: DataFrame, lo: str | float, hi: str | float, *, key: str | None = None, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """Members with lo <= score <= hi. The range reaches the scan."""
    return _page(z.where(_in_scores(lo, hi)), key, reverse, offset, count)


def zcount(z: DataFrame, lo: str | float, hi: str | float) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(_in_scores(lo, hi)).alias("n"))


def _in_lex(lo: str, hi: str) -> Column:
    m = F.col("member")

    def bound(text: str, low: bool) -> Column:
        if text[:1] == "[":
            return m >= text[1:] if low else m <= text[1:]
        if text[:1] == "(":
            return m > text[1:] if low else m < text[1:]
        if text in ("-", "+"):
            return F.lit((text == "-") == low)
        return F.lit(True)

    return bound(lo, True) & bound(hi, False)


def zrangebylex(z: DataFrame, lo: str, hi: str, *, key: str | None = None, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """Members between lexical bounds - + [x (x, in score-first order; a bound without a mark bounds nothing."""
    return _page(z.where(_in_lex(lo, hi)), key, reverse, offset, count)


def zlexcount(z: DataFrame, lo: str, hi: str) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(_in_lex(lo, hi)).alias("n"))


def zpop(z: DataFrame, count: int = 1, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): the count smallest (ZPOPMIN) or largest (ZPOPMAX) of each set."""
    r = z.withColumn("_rn", _rn(largest))
    return r.where(F.col("_rn") <= count).drop("_rn"), r.where(F.col("_rn") > count).drop("_rn")


def blocking_zpop(z: DataFrame, req: DataFrame, largest: bool = False) -> DataFrame:
    """(key, member, score): one try of BZPOPMIN or BZPOPMAX over the sets as they are."""
    first = req.join(z.select("key").distinct(), "key", "left_semi").orderBy("pos").limit(1).select("key")
    return zpop(z.join(first, "key", "left_semi"), 1, largest)[0]


def random_members(z: DataFrame, key: str, count: int = 1, seed: int = 0) -> DataFrame:
    return random_rows(z.where(F.col("key") == key).select("member", "score"), "member", count, seed)
