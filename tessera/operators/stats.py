"""Statistics over access logs and keyspaces: hot keys, latency quantiles, memory by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sketches import percentiles


def hot_keys(accesses: DataFrame, n: int) -> DataFrame:
    """(key, n) of the most accessed keys; ties by key."""
    return accesses.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n)


def latency(events: DataFrame, ps: list[float]) -> DataFrame:
    """(command, p...) quantiles of events(command, duration)."""
    return percentiles(events, "command", "duration", ps)


def latency_exact(events: DataFrame, ps: list[float]) -> DataFrame:
    q = F.percentile("duration", F.array(*[F.lit(p / 100) for p in ps]))
    return events.groupBy("command").agg(q.alias("q")).select("command", *[F.col("q")[i].alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(ps)])


def memory(sizes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, bytes): sizes(key, bytes) summed by key prefix, all prefixes in one pass; 0 where no key has it."""
    sums = sizes.agg(*[F.coalesce(F.sum(F.when(F.col("key").startswith(p), F.col("bytes"))), F.lit(0)).cast("long").alias(f"s{i}") for i, p in enumerate(prefixes)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"s{i}").alias("bytes")) for i, p in enumerate(prefixes)])).alias("x")).select("x.prefix", "x.bytes")


def top_prefixes(sizes: DataFrame, length: int, n: int) -> DataFrame:
    """(prefix, bytes) of the heaviest prefixes of a length."""
    return sizes.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "prefix").limit(n)
