"""Streams: append-only logs stream_entries(key, ms, seq, fields), groups stream_groups(key, group, last_ms, last_seq) and their pending entries
stream_pel(key, group, consumer, ms, seq, delivered_ms, deliveries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError

MIN_ID, MAX_ID = (0, 0), ((1 << 63) - 1, (1 << 63) - 1)
_AT = ["ms", "seq"]


def parse_id(text: str, fallback: tuple[int, int]) -> tuple[int, int]:
    """`ms-seq`; - and + are the ends, and what can't be read is the fallback."""
    if text in ("-", "+"):
        return MIN_ID if text == "-" else MAX_ID
    ms, dash, seq = text.partition("-")
    return (int(ms), int(seq)) if dash and ms.isdigit() and seq.isdigit() else fallback


def entry_id(ms: Column | str = "ms", seq: Column | str = "seq") -> Column:
    return F.concat_ws("-", F.col(ms) if isinstance(ms, str) else ms, F.col(seq) if isinstance(seq, str) else seq)


def _from(ms: int, seq: int, inclusive: bool = True) -> Column:
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") >= seq if inclusive else F.col("seq") > seq))


def _to(ms: int, seq: int) -> Column:
    return (F.col("ms") < ms) | ((F.col("ms") == ms) & (F.col("seq") <= seq))


def _newest_first() -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq")))


def _oldest_first() -> Column:
    return F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))


def xadd(entries: DataFrame, new: DataFrame, maxlen: int | None = None) -> DataFrame:
    """Entries with new(key, ms, seq, fields); an id that isn't above its stream's last is an error. With maxlen, old ones go."""
    last = entries.groupBy("key").agg(F.max(F.struct(*_AT)).alias("last"))
    low = F.col("last").isNotNull() & (F.struct(*_AT) <= F.col("last"))
    checked = new.join(last, "key", "left").withColumn("ms", F.when(low, F.raise_error(F.lit("ERR The ID specified in XADD is equal or smaller than the target stream top item"))).otherwise(F.col("ms")))
    out = entries.unionByName(checked.select(*entries.columns))
    return out if maxlen is None else xtrim(out, maxlen)


def auto_ids(new: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """new(key, ord, fields) with ids for `*`: the clock's ms, or the last id's if the clock is behind it, and the next sequence numbers."""
    last = entries.groupBy("key").agg(F.max(F.struct(*_AT)).alias("last"))
    rn = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    ms = F.greatest(F.lit(now_ms), F.coalesce("last.ms", F.lit(now_ms)))
    base = F.when(F.col("last.ms") >= now_ms, F.col("last.seq") + 1).otherwise(0)
    return new.join(last, "key", "left").select("key", ms.cast("long").alias("ms"), (base + rn - 1).cast("long").alias("seq"), "fields")


def xlen(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.count("*").alias("length"))


def xrange(entries: DataFrame, start: str = "-", end: str = "+", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Entries from start to end, both included; `count` of each stream from that end where reading starts. The range on ms reaches the scan."""
    a, b = parse_id(start, MIN_ID), parse_id(end, MAX_ID)
    out = entries.where((F.col("ms") >= a[0]) & (F.col("ms") <= b[0]) & _from(*a) & _to(*b))
    if count is not None:
        out = out.withColumn("_rn", _newest_first() if reverse else _oldest_first()).where(F.col("_rn") <= count).drop("_rn")
    return out


def xread(entries: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """Entries beyond each stream's cursor in after(key, after_ms, after_seq); `count` of each stream. Streams without a cursor (`$`, unreadable ids) are left out of `after`."""
    out = entries.join(after, "key").where((F.col("ms") > F.col("after_ms")) | ((F.col("ms") == F.col("after_ms")) & (F.col("seq") > F.col("after_seq")))).select(*entries.columns)
    if count is not None:
        out = out.withColumn("_rn", _oldest_first()).where(F.col("_rn") <= count).drop("_rn")
    return out


def xtrim(entries: DataFrame, maxlen: int) -> DataFrame:
    """The newest maxlen entries of each stream."""
    return entries.withColumn("_rn", _newest_first()).where(F.col("_rn") <= maxlen).drop("_rn")


def xtrimmed(entries: DataFrame, maxlen: int) -> DataFrame:
    """(key, removed): how many a trim removes; only counts are shuffled."""
    return entries.groupBy("key").agg(F.greatest(F.count("*") - maxlen, F.lit(0)).alias("removed"))


def xdel(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone, ["key", *_AT], "left_anti")


def xinfo_stream(entries: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(key, length, first, last, last_generated, groups)."""
    out = entries.groupBy("key").agg(F.count("*").alias("length"), F.min(F.struct(*_AT)).alias("a"), F.max(F.struct(*_AT)).alias("b"))
    n = groups.groupBy("key").agg(F.count("*").alias("groups")) if groups is not None else None
    out = out.join(n, "key", "left") if n is not None else out.withColumn("groups", F.lit(0))
    first, last = entry_id(F.col("a.ms"), F.col("a.seq")), entry_id(F.col("b.ms"), F.col("b.seq"))
    return out.select("key", "length", first.alias("first"), last.alias("last"), last.alias("last_generated"), F.coalesce("groups", F.lit(0)).cast("long").alias("groups"))


def xinfo_groups(groups: DataFrame, pel: DataFrame) -> DataFrame:
    """(key, group, consumers, pending, last_delivered)."""
    n = pel.groupBy("key", "group").agg(F.countDistinct("consumer").alias("consumers"), F.count("*").alias("pending"))
    zero = F.lit(0).cast("long")
    return groups.join(n, ["key", "group"], "left").select("key", "group", F.coalesce("consumers", zero).alias("consumers"), F.coalesce("pending", zero).alias("pending"), entry_id("last_ms", "last_seq").alias("last_delivered"))


# --- consumer groups


def group_create(groups: DataFrame, entries: DataFrame, key: str, group: str, start: str = "$", mkstream: bool = False) -> DataFrame:
    if not groups.where((F.col("key") == key) & (F.col("group") == group)).isEmpty():
        raise CommandError("BUSYGROUP Consumer Group name already exists")
    own = entries.where(F.col("key") == key)
    if not mkstream and own.isEmpty():
        raise CommandError("ERR The XGROUP subcommand requires the key to exist")
    if start == "$":
        at = own.agg(F.max(F.struct(*_AT)).alias("m")).select(F.coalesce("m.ms", F.lit(0)).cast("long").alias("last_ms"), F.coalesce("m.seq", F.lit(0)).cast("long").alias("last_seq"))
    else:
        ms, seq = parse_id(start, MIN_ID)
        at = entries.sparkSession.range(1).select(F.lit(ms).cast("long").alias("last_ms"), F.lit(seq).cast("long").alias("last_seq"))
    return groups.unionByName(at.select(F.lit(key).alias("key"), F.lit(group).alias("group"), "last_ms", "last_seq"))


def group_destroy(groups: DataFrame, pel: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    keep = ~((F.col("key") == key) & (F.col("group") == group))
    return groups.where(keep), pel.where(keep)


def del_consumer(pel: DataFrame, key: str, group: str, consumer: str) -> DataFrame:
    return pel.where(~((F.col("key") == key) & (F.col("group") == group) & (F.col("consumer") == consumer)))


def read_new(entries: DataFrame, groups: DataFrame, group: str, count: int | None = None) -> DataFrame:
    """What XREADGROUP `>` delivers from each stream of the group: entries beyond its last delivered id."""
    g = groups.where(F.col("group") == group).select("key", F.col("last_ms").alias("after_ms"), F.col("last_seq").alias("after_seq"))
    return xread(entries, g, count)


def deliver(groups: DataFrame, pel: DataFrame, delivered: DataFrame, group: str, consumer: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(groups, pending entries) after a delivery; a group that didn't exist is made."""
    top = delivered.groupBy("key").agg(F.max(F.struct(*_AT)).alias("t")).select("key", F.lit(group).alias("group"), F.col("t.ms").alias("last_ms"), F.col("t.seq").alias("last_seq"))
    new = delivered.select("key", F.lit(group).alias("group"), F.lit(consumer).alias("consumer"), *_AT, F.lit(now_ms).cast("long").alias("delivered_ms"), F.lit(1).cast("long").alias("deliveries"))
    return groups.join(top, ["key", "group"], "left_anti").unionByName(top.select(*groups.columns)), pel.unionByName(new.select(*pel.columns))


def replay(entries: DataFrame, pel: DataFrame, group: str, consumer: str) -> DataFrame:
    """What XREADGROUP with any other id returns: the consumer's own pending entries."""
    own = pel.where((F.col("group") == group) & (F.col("consumer") == consumer)).select("key", *_AT)
    return entries.join(own, ["key", *_AT], "left_semi")


def xack(pel: DataFrame, done: DataFrame) -> DataFrame:
    """Pending entries without those in done(key, group, ms, seq)."""
    return pel.join(done, ["key", "group", *_AT], "left_anti")


def xpending(pel: DataFrame) -> DataFrame:
    """(key, group, consumer, pending, first, last): the summary by consumer."""
    g = pel.groupBy("key", "group", "consumer").agg(F.count("*").alias("pending"), F.min(F.struct(*_AT)).alias("a"), F.max(F.struct(*_AT)).alias("b"))
    return g.select("key", "group", "consumer", "pending", entry_id(F.col("a.ms"), F.col("a.seq")).alias("first"), entry_id(F.col("b.ms"), F.col("b.seq")).alias("last"))


def xpending_detail(pel: DataFrame, start: str, end: str, count: int, now_ms: int) -> DataFrame:
    """(key, id, consumer, idle, deliveries) of the first `count` pending entries in a range of ids."""
    a, b = parse_id(start, MIN_ID), parse_id(end, MAX_ID)
    page = pel.where(_from(*a) & _to(*b)).orderBy("ms", "seq").limit(count)
    return page.select("key", entry_id().alias("id"), "consumer", (now_ms - F.col("delivered_ms")).alias("idle"), "deliveries")


def xclaim(pel: DataFrame, wanted: DataFrame, consumer: str, min_idle: int, now_ms: int) -> DataFrame:
    """Pending entries with those of wanted(key, group, ms, seq) that are idle for min_idle ms moved to a consumer, delivered once more."""
    hit = wanted.select("key", "group", *_AT, F.lit(True).alias("_w")).distinct()
    take = F.coalesce("_w", F.lit(False)) & (now_ms - F.col("delivered_ms") >= min_idle)
    j = pel.join(hit, ["key", "group", *_AT], "left").withColumn("_t", take)
    return j.withColumns(
        {"consumer": F.when(F.col("_t"), F.lit(consumer)).otherwise(F.col("consumer")), "delivered_ms": F.when(F.col("_t"), F.lit(now_ms).cast("long")).otherwise(F.col("delivered_ms")), "deliveries": F.when(F.col("_t"), F.col("deliveries") + 1).otherwise(F.col("deliveries"))}
    ).select(*pel.columns)


def autoclaim_candidates(pel: DataFrame, key: str, group: str, min_idle: int, start: str, now_ms: int, count: int = 100) -> DataFrame:
    """(key, group, ms, seq) that XAUTOCLAIM takes: the first `count` idle entries from start on."""
    a = parse_id(start, MIN_ID)
    own = pel.where((F.col("key") == key) & (F.col("group") == group) & (now_ms - F.col("delivered_ms") >= min_idle) & _from(*a))
    return own.orderBy("ms", "seq").limit(count).select("key", "group", *_AT)


def autoclaim_cursor(taken: DataFrame) -> DataFrame:
    """(next): the id after the last one taken, 0-0 if none was."""
    m = taken.agg(F.max(F.struct(*_AT)).alias("m"))
    return m.select(F.when(F.col("m").isNull(), "0-0").otherwise(entry_id(F.col("m.ms"), F.col("m.seq") + 1)).alias("next"))
