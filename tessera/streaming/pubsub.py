"""Publish and subscribe: messages(channel, message) against subscriptions(conn, kind, pattern), on batches or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import glob, glob_regex


#: Characters of a glob's text by which it meets channels.
PART = 32


def subscribe(subscriptions: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (conn, kind, pattern) rows, kind `exact` or `glob`; a repeated one counts once."""
    return subscriptions.unionByName(new).distinct()


def unsubscribe(subscriptions: DataFrame, conn: str, patterns: list[str] | None = None, kind: str = "exact") -> DataFrame:
    """Without patterns, all of a connection's of that kind."""
    gone = (F.col("conn") == conn) & (F.col("kind") == kind)
    return subscriptions.where(~(gone if patterns is None else gone & F.col("pattern").isin(patterns)))


def listen(messages: DataFrame, channels: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """Messages of the channels and of channels that match a glob."""
    hit = F.lit(False)
    if channels:
        hit = hit | F.col("channel").isin(channels)
    for p in patterns or []:
        hit = hit | glob(F.col("channel"), p)
    return messages.where(hit)


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(channel, message, conn, pattern): one row for each delivery. A connection that matches exactly and by pattern gets two.

    Exact subscriptions are an equality join. Globs are matched against distinct channels, not against messages.
    """
    exact = subscriptions.where("kind = 'exact'").select("conn", F.col("pattern").alias("channel"), F.lit(None).cast("string").alias("pattern"))
    by_glob = subscriptions.where("kind = 'glob'").select("conn", "pattern")
    chosen = [r[0] for r in by_glob.select("pattern").distinct().limit(1001).collect()]
    names = messages.select("channel").distinct()
    if len(chosen) <= 1000:
        fits = F.array_compact(F.array(*[F.when(glob(F.col("channel"), p), p) for p in chosen])) if chosen else F.array().cast("array<string>")
        matched = names.select("channel", F.explode(fits).alias("pattern"))
    else:
        matched = _matched(names, by_glob.select("pattern").distinct())
    pairs = exact.unionByName(matched.join(by_glob, "pattern").select("conn", "channel", "pattern"))
    return messages.join(pairs, "channel").select("channel", "message", "conn", "pattern")


def _matched(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """(channel, pattern) that fit, for many patterns: a glob meets the channels that begin with its text before the first wildcard, or
    end with that after the last one, by an equality join; only globs with wildcards at both ends meet every channel."""
    head, tail = F.regexp_extract("pattern", r"^[^*?]*", 0), F.regexp_extract("pattern", r"[^*?]*$", 0)
    rx = F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([^A-Za-z0-9_*? ])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    side = F.when(head != "", "head").when(tail != "", "tail").otherwise("none")
    pats = patterns.select("pattern", rx.alias("rx"), side.alias("side"), F.when(head != "", F.substring(head, 1, PART)).otherwise(F.right(tail, F.lit(PART))).alias("part"))
    parts = pats.where("side != 'none'").select("side", F.length("part")).distinct().collect()  # at most 2 x PART rows
    cut = [F.struct(F.lit(k).alias("side"), (F.substring("channel", 1, n) if k == "head" else F.right("channel", F.lit(n))).alias("part")) for k, n in parts]
    cut.append(F.struct(F.lit("none").alias("side"), F.lit("").alias("part")))
    keyed = names.select("channel", F.explode(F.array(*cut)).alias("k")).select("channel", "k.side", "k.part")
    return keyed.join(pats, ["side", "part"]).where(F.expr("channel rlike rx")).select("channel", "pattern").distinct()


def publish_counts(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(channel, message, receivers): what PUBLISH returns."""
    d = deliveries(messages, subscriptions).groupBy("channel", "message").agg(F.count("*").alias("receivers"))
    return messages.join(d, ["channel", "message"], "left").select("channel", "message", F.coalesce("receivers", F.lit(0)).alias("receivers"))


__all__ = ["deliveries", "glob_regex", "listen", "publish_counts", "subscribe", "unsubscribe"]
