"""Bitmaps: rows bitmaps(key, byte BIGINT, bits INT) of non-zero bytes, most significant bit first, and lengths in bytes; packed integers over BINARY values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators.order import lookup


def from_offsets(bits: DataFrame) -> DataFrame:
    """(key, byte, bits) of set bits (key, offset): the bytes are or-ed within tasks first."""
    mask = F.expr("shiftright(128, cast(offset % 8 as int))")
    return bits.groupBy("key", F.floor(F.col("offset") / 8).cast("long").alias("byte")).agg(F.bit_or(mask).cast("int").alias("bits"))


def from_binary(values: DataFrame) -> DataFrame:
    """(key, byte, bits) of values (key, value BINARY)."""
    n = F.octet_length("value")
    at = values.where(n > 0).select("key", "value", F.explode(F.sequence(F.lit(0), n - 1)).alias("byte"))
    bits = F.conv(F.hex(F.substring("value", F.col("byte") + 1, F.lit(1))), 16, 10).cast("int")
    return at.select("key", F.col("byte").cast("long").alias("byte"), bits.alias("bits")).where("bits != 0")


def setbit(bitmaps: DataFrame, key: str, offset: int, on: bool) -> DataFrame:
    """bitmaps with one bit set or cleared."""
    byte, mask = offset // 8, 128 >> offset % 8
    here = (F.col("key") == key) & (F.col("byte") == byte)
    one = bitmaps.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(byte).cast("long").alias("byte"), F.lit(mask if on else 0).alias("bits"))
    kept = bitmaps.where(~here).unionByName(bitmaps.where(here).withColumn("bits", F.col("bits").bitwiseAND(F.lit(255 ^ mask))).unionByName(one).groupBy("key", "byte").agg(F.bit_or("bits").alias("bits")))
    return kept.where("bits != 0")


def getbit(bitmaps: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, key, offset, bit) of each request, 0 where nothing is stored."""
    at = req.withColumn("byte", F.floor(F.col("offset") / 8).cast("long"))
    bit = F.expr("shiftright(coalesce(bits, 0), 7 - cast(offset % 8 as int)) & 1").cast("long")
    return lookup(at, bitmaps, "key", "byte").select("pos", "key", "offset", bit.alias("bit"))


def bitcount(bitmaps: DataFrame, start: int | None = None, end: int | None = None, bits: bool = False) -> DataFrame:
    """(key, n): set bits in all, or between two byte (or bit) positions, both included and not negative."""
    b = F.col("bits")
    if start is not None:
        first, last = (start // 8, end // 8) if bits else (start, end)
        bitmaps = bitmaps.where(F.col("byte").between(first, last))
        if bits:
            low, high = 255 >> start % 8, 255 ^ (255 >> (end % 8 + 1))
            b = F.when(F.col("byte") == first, b.bitwiseAND(F.lit(low))).otherwise(b)
            b = F.when(F.col("byte") == last, b.bitwiseAND(F.lit(high))).otherwise(b)
    return bitmaps.groupBy("key").agg(F.sum(F.bit_count(b)).cast("long").alias("n"))


def bitop(bitmaps: DataFrame, op: str, destination: str, keys: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """(key, byte, bits) of a combination under the destination's name; missing bytes are zeros. NOT takes one key, and its bytes up to
    the end that lengths(key, n) says, without it up to the last non-zero one."""
    op, some = op.upper(), bitmaps.where(F.col("key").isin(keys))
    by_byte = some.groupBy("byte")
    if op == "AND":
        out = by_byte.agg(F.count("*").alias("c"), F.bit_and("bits").alias("bits")).where(F.col("c") == len(set(keys))).drop("c")
    elif op in ("OR", "XOR"):
        out = by_byte.agg((F.bit_or if op == "OR" else F.bit_xor)("bits").alias("bits"))
    elif op == "NOT":
        if len(keys) != 1:
            raise CommandError("ERR BITOP NOT must be called with a single source key.")
        last = some.agg(F.max("byte").alias("last")) if lengths is None else lengths.where((F.col("key") == keys[0]) & (F.col("n") > 0)).select((F.col("n") - 1).cast("long").alias("last"))
        every = last.select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("byte"))
        out = every.join(some.select("byte", "bits"), "byte", "left").select("byte", F.lit(255).bitwiseXOR(F.coalesce("bits", F.lit(0))).alias("bits"))
    else:
        raise CommandError("ERR syntax error")
    return out.where("bits != 0").select(F.lit(destination).alias("key"), "byte", "bits")


def bitpos(bitmaps: DataFrame, lengths: DataFrame, bit: int, start: int = 0) -> DataFrame:
    """(key, pos): the first set or clear bit from a byte on. Without one: -1 for 1; for 0, the bit after the value's end. lengths(key, n) in bytes."""
    b = F.col("bits")
    if bit:
        lead = F.expr("8 - length(conv(bits, 10, 2))")
        found = bitmaps.where(F.col("byte") >= start).groupBy("key").agg(F.min(F.col("byte") * 8 + lead).alias("p"))
        return lengths.join(found, "key", "left").select("key", F.coalesce("p", F.lit(-1)).cast("long").alias("pos"))
    full = bitmaps.where((F.col("byte") >= start) & (b == 255)).select("key", "byte")
    rank = F.expr("byte - row_number() over (partition by key order by byte) + 1")
    run = full.withColumn("g", rank).where(F.col("g") == start).groupBy("key").agg(F.count("*").alias("full"))
    at = lengths.join(run, "key", "left").withColumn("byte", start + F.coalesce("full", F.lit(0)))
    nxt = at.join(bitmaps, ["key", "byte"], "left")
    lead0 = F.expr("8 - length(conv(255 - coalesce(bits, 0), 10, 2))")
    return nxt.select("key", F.when(F.col("byte") >= F.col("n"), F.col("n") * 8).otherwise(F.col("byte") * 8 + lead0).cast("long").alias("pos"))


@dataclass(frozen=True)
class Field:
    """A packed integer: signed or not, its width, and its offset in bits."""

    signed: bool
    width: int
    offset: int

    @staticmethod
    def parse(kind: str, offset: str) -> Field:
        m = re.fullmatch(r"([iu])(\d{1,2})", kind)
        if not m or not 1 <= int(m[2]) <= (64 if m[1] == "i" else 63):
            raise CommandError("ERR Invalid bitfield type. Use something like i16 u8. Note that u64 is not supported but i64 is.")
        width, scaled = int(m[2]), offset.startswith("#")
        return Field(m[1] == "i", width, int(offset[scaled:]) * (width if scaled else 1))

    @property
    def low(self) -> int:
        return -(1 << self.width - 1) if self.signed else 0

    @property
    def high(self) -> int:
        return (1 << self.width - self.signed) - 1


def field_get(value: Column, f: Field) -> Column:
    """The field of a BINARY value, bytes past its end being zeros, as BIGINT."""
    first, last = f.offset // 8, (f.offset + f.width - 1) // 8
    part = F.rpad(F.hex(F.substring(value, first + 1, last - first + 1)), 2 * (last - first + 1), "0")
    bits = F.concat(*[F.lpad(F.conv(F.substring(part, 2 * i + 1, 2), 16, 2), 8, "0") for i in range(last - first + 1)])
    own = F.substring(bits, f.offset % 8 + 1, f.width)
    n = F.conv(own, 2, 10).cast("decimal(20,0)")
    if f.signed:
        n = F.when(n > f.high, n - F.lit(1 << f.width).cast("decimal(20,0)")).otherwise(n)
    return n.cast("bigint")


def field_incr(value: Column, f: Field, delta: int, overflow: str = "WRAP") -> Column:
    """The field plus delta: wrapped, kept at the end it passes (SAT), or null (FAIL)."""
    wide = lambda x: F.lit(x).cast("decimal(38,0)")
    n = field_get(value, f).cast("decimal(20,0)") + wide(delta)
    outside = (n > wide(f.high)) | (n < wide(f.low))
    if overflow == "FAIL":
        n = F.when(~outside, n)
    elif overflow == "SAT":
        n = F.least(F.greatest(n, wide(f.low)), wide(f.high))
    else:
        span = wide(1 << f.width)
        n = F.pmod(n - wide(f.low), span) + wide(f.low)
    return n.cast("bigint")


def field_set(value: Column, f: Field, new: Column) -> Column:
    """value with the field overwritten by the low bits of a BIGINT, grown with zeros where it is too short."""
    first, last = f.offset // 8, (f.offset + f.width - 1) // 8
    size = last - first + 1
    whole = F.when(F.octet_length(value) > last, F.hex(value)).otherwise(F.rpad(F.hex(value), 2 * (last + 1), "0"))
    part = F.substring(whole, 2 * first + 1, 2 * size)
    bits = F.concat(*[F.lpad(F.conv(F.substring(part, 2 * i + 1, 2), 16, 2), 8, "0") for i in range(size)])
    own = F.lpad(F.right(F.bin(new), F.lit(f.width)), f.width, "0")
    at = f.offset % 8
    made = F.concat(F.substring(bits, 1, at), own, F.substring(bits, F.lit(at + f.width + 1), F.lit(size * 8)))
    text = F.concat(*[F.lpad(F.conv(F.substring(made, 8 * i + 1, 8), 2, 16), 2, "0") for i in range(size)])
    return F.unhex(F.concat(F.substring(whole, 1, 2 * first), text, F.substring(whole, F.lit(2 * (last + 1) + 1), F.length(whole))))
