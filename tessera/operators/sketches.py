"""Sketches as mergeable columns: distinct counts (HyperLogLog), frequencies (Count-Min), quantiles. All aggregate partially within tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^14 registers: about 0.8 % standard error.
LOG_REGISTERS = 14
#: Rows and columns of the frequency sketch.
DEPTH, WIDTH = 4, 64


def pfadd(sketches: DataFrame, new: DataFrame) -> DataFrame:
    """sketches(key, sketch) with the elements of new(key, element) counted in."""
    made = new.groupBy("key").agg(F.hll_sketch_agg(F.col("element"), F.lit(LOG_REGISTERS)).alias("sketch"))
    return merge(sketches.unionByName(made))


def merge(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("key").agg(F.hll_union_agg("sketch").alias("sketch"))


def pfcount(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(n): estimated distinct elements of the union of the keys' sketches; 0 if there is none."""
    u = sketches.where(F.col("key").isin(keys)).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    return u.select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pfmerge(sketches: DataFrame, destination: str, sources: list[str]) -> DataFrame:
    """sketches with the destination replaced by the union of itself and the sources."""
    taken = sketches.where(F.col("key").isin([destination, *sources])).agg(F.hll_union_agg("sketch").alias("sketch")).where(F.col("sketch").isNotNull())
    return sketches.where(F.col("key") != destination).unionByName(taken.select(F.lit(destination).alias("key"), "sketch"))


def _cells(item: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(item, F.lit(d)), F.lit(WIDTH)).cast("int") for d in range(DEPTH)]


def count_min(events: DataFrame, item: str) -> DataFrame:
    """(depth, cell, n): a frequency sketch of DEPTH x WIDTH counters."""
    return events.select(F.posexplode(F.array(*_cells(F.col(item)))).alias("depth", "cell")).groupBy("depth", "cell").agg(F.count("*").alias("n"))


def count_min_estimate(sketch: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """(item, estimate): the least of an item's counters, never below its true count."""
    at = items.select(item, F.posexplode(F.array(*_cells(F.col(item)))).alias("depth", "cell"))
    return at.join(F.broadcast(sketch), ["depth", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))  # DEPTH * WIDTH rows


def count_min_decay(sketch: DataFrame) -> DataFrame:
    """Every counter halved."""
    return sketch.withColumn("n", F.floor(F.col("n") / 2))


def percentiles(events: DataFrame, by: str, value: str, ps: list[float], accuracy: int = 10_000) -> DataFrame:
    """(by, p50, ...): approximate quantiles of a value, a mergeable summary of each group."""
    q = F.percentile_approx(value, [p / 100 for p in ps], accuracy)
    return events.groupBy(by).agg(q.alias("q")).select(by, *[F.col("q")[i].alias(f"p{p:g}".replace(".", "_")) for i, p in enumerate(ps)])
