"""RESP frames: a parser and a serializer of the text protocol, so that recorded traffic can be read and replies written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessera.errors import CommandError


def parse(data: bytes, at: int = 0) -> tuple[object, int] | None:
    """(value, next position) of the frame at a position; None if it isn't whole yet."""
    end = data.find(b"\r\n", at)
    if end < 0:
        return None
    kind, head, at = data[at : at + 1], data[at + 1 : end], end + 2
    if kind in b"+-:,#(_" and kind:
        text = head.decode("utf-8", "replace")
        try:
            value = {b"+": lambda: text, b"-": lambda: CommandError(text), b":": lambda: int(text), b",": lambda: float(text), b"#": lambda: text == "t", b"(": lambda: int(text), b"_": lambda: None}[kind]()
        except ValueError:
            raise CommandError("ERR Protocol error") from None
        return value, at
    if kind not in (b"$", b"*", b"%", b"~", b"=", b"!", b">") or not head.lstrip(b"-").isdigit():
        raise CommandError("ERR Protocol error")
    n = int(head)
    if n < 0:
        return None if kind not in (b"$", b"*") else (None, at)
    if kind in (b"$", b"=", b"!"):
        if len(data) < at + n + 2:
            return None
        body = data[at : at + n]
        return (body[4:] if kind == b"=" else CommandError(body.decode("utf-8", "replace")) if kind == b"!" else body), at + n + 2
    items = []
    for _ in range(2 * n if kind == b"%" else n):
        got = parse(data, at)
        if got is None:
            return None
        items.append(got[0])
        at = got[1]
    return (dict(zip(items[::2], items[1::2], strict=True)) if kind == b"%" else items), at


def frames(data: bytes) -> Iterator[object]:
    at = 0
    while (got := parse(data, at)) is not None:
        yield got[0]
        at = got[1]


def serialize(value: object, resp3: bool = False) -> bytes:
    """A reply frame; maps, booleans, doubles and null have frames of their own in version 3 only."""
    match value:
        case None:
            return b"_\r\n" if resp3 else b"$-1\r\n"
        case bool():
            return (b"#t\r\n" if value else b"#f\r\n") if resp3 else b":%d\r\n" % value
        case int():
            return b":%d\r\n" % value
        case float():
            text = repr(value).removesuffix(".0").encode()
            return b",%s\r\n" % text if resp3 else b"$%d\r\n%s\r\n" % (len(text), text)
        case str():
            raw = value.encode()
            return b"$%d\r\n%s\r\n" % (len(raw), raw)
        case bytes():
            return b"$%d\r\n%s\r\n" % (len(value), value)
        case Exception():
            return b"-%s\r\n" % str(value).encode()
        case dict():
            flat = [x for kv in value.items() for x in kv]
            return (b"%%%d\r\n" % len(value) if resp3 else b"*%d\r\n" % len(flat)) + b"".join(serialize(x, resp3) for x in flat)
        case list() | tuple():
            return b"*%d\r\n" % len(value) + b"".join(serialize(x, resp3) for x in value)
    raise TypeError(type(value))


def commands(files: DataFrame) -> DataFrame:
    """(path, pos, args ARRAY<STRING>) of recorded traffic read by spark.read.format("binaryFile"): one file is one connection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                args = [[x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x) for x in f] for f in frames(bytes(content)) if isinstance(f, list)]
                yield pd.DataFrame({"path": path, "pos": range(len(args)), "args": args})

    return files.select("path", "content").mapInPandas(run, "path string, pos long, args array<string>")
