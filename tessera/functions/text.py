"""Scalar functions on keys and values: globs, byte ranges, numbers as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """Whole-text regular expression of a glob with * and ? only."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", c) if ord(c) < 128 else c for c in pattern) + "$"


def glob(c: Column, pattern: str) -> Column:
    if pattern == "*":
        return F.lit(True)
    if not re.search(r"[*?]", pattern):
        return c == pattern
    if re.fullmatch(r"[^*?]*\*", pattern):
        return c.startswith(pattern[:-1])  # reaches the scan as a prefix
    return c.rlike(glob_regex(pattern))


def clamp_range(n: Column, start: int, stop: int) -> tuple[Column, Column]:
    """Inclusive 0-based bounds of a range with negative indexes from the tail; bounds that are too low become 0, too high the last."""
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.lit(i)
    return at(start), F.least(at(stop), n - 1)


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes start..stop of a binary value, inclusive; empty where the range is."""
    a, b = clamp_range(F.octet_length(value), start, stop)
    return F.when(a > b, F.lit(b"")).otherwise(F.substring(value, a + 1, b - a + 1))


def overlay_bytes(value: Column, offset: int, new: bytes) -> Column:
    """value with `new` written at a byte offset, a gap filled by zeros; unchanged if `new` is empty."""
    if not new:
        return value
    n = F.octet_length(value)
    head = F.when(n >= offset, F.substring(value, 1, offset)).otherwise(F.concat(value, F.unhex(F.repeat(F.lit("00"), F.lit(offset) - n)))) if offset else F.lit(b"")
    end = offset + len(new)
    return F.concat(head, F.lit(new), F.when(n > end, F.substring(value, F.lit(end + 1), n - end)).otherwise(F.lit(b"")))


def integer(value: Column) -> Column:
    """A 64-bit integer from its decimal text (binary or string); null for any other text."""
    s = value.cast("string")
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("bigint"))


def float_text(x: Column) -> Column:
    """The shortest text of a double, without exponent; whole numbers without a fraction."""
    s = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.when(x == 0, "0").otherwise(x.cast("bigint").cast("string"))).when(s.contains("E"), F.coalesce(plain, s)).otherwise(s)
