"""Joins of few requests and row numbers of many rows, by what the tables' sizes allow: no whole table is shuffled for a few keys, and no task sorts a whole large table or key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Optimizer's size of a table of keys up to which it is broadcast unseen, rows up to which it is broadcast when counted.
SMALL_BYTES, BROADCAST_KEYS = 1 << 20, 200_000
#: Optimizer's size of a table up to which one task may sort a key of it, and all of it.
KEY_BYTES, TABLE_BYTES = 256 << 20, 1 << 14
#: Rows of a table's sample, and ranges that it is cut into, to number its rows.
SAMPLE, RANGES = 4000, 200


def size(df: DataFrame) -> int:
    """Bytes as the optimizer knows or overrates them, without a job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def few(keys: DataFrame) -> bool:
    """Whether a table of distinct keys may be broadcast: by its known size, else by a count that stops at the bound."""
    return size(keys) <= SMALL_BYTES or keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def wanted(table: DataFrame, req: DataFrame, *on: str) -> DataFrame:
    """The rows of a table that a request names; no shuffle of the table if the requests are few."""
    keys = req.select(*on).distinct()
    return table.join(F.broadcast(keys) if few(keys) else keys, list(on), "left_semi")


def lookup(req: DataFrame, table: DataFrame, *on: str) -> DataFrame:
    """req with the columns of the table's rows of the same keys, or nulls. For few requests the table is cut to their keys before anything is shuffled."""
    keys = req.select(*on).distinct()
    if few(keys):
        table = table.join(F.broadcast(keys), list(on), "left_semi")
    return req.join(table, list(on), "left")


def _bounds(df: DataFrame, order: Column) -> list:
    """Values that cut the rows into about RANGES ranges of equal numbers, from a sample by hash of known size."""
    n = df.count()
    rows = df.select(order.alias("o"))
    sample = sorted((r["o"] for r in (rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("o"), F.lit(1 << 20)) < SAMPLE / n * (1 << 20))).limit(4 * SAMPLE).collect()))
    step = max(1, len(sample) // RANGES)
    return sample[step::step]


def numbered(df: DataFrame, name: str, key: Column, *ties: str) -> DataFrame:
    """df with the 0-based place of each row in the order of a column (without nulls), then of others, as `name`.

    Rows are dealt to ranges of the column by fixed bounds, numbered within them and moved by the rows of the ranges
    before, so that no task sorts more than a range, or the rows of one value. A table of a few KB is sorted as it is.
    """
    if size(df) <= TABLE_BYTES:
        return df.withColumn(name, F.row_number().over(Window.orderBy(key, *ties)).cast("long") - 1)
    bounds = _bounds(df, key)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_o"))) if bounds else F.col("_o").isNull().cast("int")
    dealt = df.withColumn("_o", key).withColumn("_range", at)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_o", *ties)) - 1
    return dealt.withColumn("_at", place).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*[c for c in df.columns if c != name], name)


def ranked(df: DataFrame, name: str, by: str, key: Column, *ties: Column, reverse: bool = False, total: str | None = None) -> DataFrame:
    """df with the 0-based place of each row among those of its `by`, in the order of key and ties (both turned by `reverse`), and as `total` how many they are.

    One window of each `by`; where the table is so large that one of them may not fit a task, each is cut into ranges of `key`.
    """
    turned = [c.desc() if reverse else c.asc() for c in (key, *ties)]
    if size(df) <= KEY_BYTES:
        out = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*turned)).cast("long") - 1)
        return out.withColumn(total, F.count("*").over(Window.partitionBy(by))) if total else out
    bounds = _bounds(df, key)
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("_o"))) if bounds else F.lit(0)
    at = -at if reverse else at
    dealt = df.withColumn("_o", key).withColumn("_range", at)
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(by).orderBy("_range")  # at most RANGES rows of each `by`
    before = sizes.select(F.col(by), "_range", (F.sum("_n").over(own) - F.col("_n")).alias("_before"), *([F.sum("_n").over(Window.partitionBy(by)).alias(total)] if total else []))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*turned)) - 1
    return dealt.withColumn("_at", place).join(before, [by, "_range"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*[c for c in df.columns if c != name], name, *([total] if total else []))
