"""Byte-level BPE: pre-tokens found by a scan of transition functions over code-point classes, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces whose ids a task remembers; the cache starts anew when it is full.
CACHE = 200_000
#: Characters that are pre-tokenised at once; a longer text is one block of its own.
BLOCK = 1 << 20

# The white space of Unicode.
_SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Classes of code points.
OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols of the scan: a class, or what the next characters make of it.
O, L, N, W, JOIN, LAST, SHORT, LONG = range(8)  # JOIN: a blank before a non-space; LAST: other last white space of a run; SHORT, LONG: an apostrophe that may begin 's or 're
# States: what the token at hand is. The scan is after a character of it.
IN_O, IN_L, IN_N, IN_W, BLANK, LEFT1, LEFT2, FRESH = range(8)  # BLANK: a blank that the next character joins; LEFT1, LEFT2: letters of a contraction to come; FRESH: a new token follows


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        out[c] = LETTER if k == "L" else NUMBER if k == "N" else OTHER
    out[list(_SPACES)] = SPACE
    return out


def _move(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character, and whether a token begins at it."""
    if state in (LEFT1, LEFT2):
        return (FRESH if state == LEFT1 else LEFT1), False
    if symbol == L:
        return IN_L, state not in (IN_L, BLANK)
    if symbol == N:
        return IN_N, state not in (IN_N, BLANK)
    if symbol in (O, SHORT, LONG):
        if state in (IN_O, BLANK):
            return IN_O, False
        return {O: IN_O, SHORT: LEFT1, LONG: LEFT2}[symbol], True
    if symbol == W:
        return IN_W, state != IN_W
    return (BLANK if symbol == JOIN else FRESH), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions on states that strings of symbols make, numbered: (of each symbol, composition table, state after the start, whether a token begins, by state and symbol)."""
    gens = [tuple(_move(s, c)[0] for s in range(8)) for c in range(8)]
    starts = [tuple([_move(FRESH, c)[0]] * 8) for c in range(8)]  # the first character of a text forgets what was before
    known = {f: i for i, f in enumerate(dict.fromkeys([*gens, *starts]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in [*gens, *starts]:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    names = list(known)
    table = np.array([[known[tuple(g[s] for s in f)] for g in names] for f in names], np.uint16)
    begins = np.array([[_move(s, c)[1] for c in range(8)] for s in range(8)])
    return np.array([known[f] for f in [*gens, *starts]], np.uint16), table, np.array([f[FRESH] for f in names], np.uint8), begins


def scan(functions: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions: within columns of a square first, then over the columns' ends, then both together."""
    n = len(functions)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    grid = np.zeros(rows * width, functions.dtype)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)  # a row holds one step of each segment
    for k in range(1, width):
        grid[k] = table[grid[k - 1], grid[k]]
    carry, ends = grid[-1].copy(), grid[-1]
    for k in range(1, rows):
        carry[k] = table[carry[k - 1], ends[k]]
    if rows > 1:
        grid[:, 1:] = table[carry[:-1][None, :], grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


def boundaries(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin in concatenated texts; `first` marks the first character of each."""
    symbol_of, table, after, begins = monoid()
    n = len(codes)
    kind = classes()[codes]
    end = np.append(first[1:], True)  # the last character of a text
    following = np.append(kind[1:], SPACE)
    sym = np.array([O, L, N, W], np.uint8)[kind]
    last = (kind == SPACE) & ~end & (following != SPACE)
    sym[last] = np.where(codes[last] == 0x20, JOIN, LAST)
    for at in np.flatnonzero(codes == 0x27):
        stop = at + 1 + int(np.argmax(end[at : at + 3])) if end[at : at + 3].any() else at + 3
        tail = "".join(map(chr, codes[at + 1 : stop]))
        if tail[:1] in ("s", "t", "m", "d"):
            sym[at] = SHORT
        elif tail in ("re", "ve", "ll"):
            sym[at] = LONG
    before = np.empty(n, np.uint8)
    before[0] = FRESH
    before[1:] = after[scan(symbol_of[sym + 8 * first], table)][:-1]
    before[first] = FRESH
    return begins[before, sym]


class Encoder:
    """Ranks of byte strings, and the ids of pieces that it has merged."""

    def __init__(self, path: str = RANKS) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of lowest rank merges, the leftmost first, until none can."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        if n > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        pair = [ranks.get(parts[i] + parts[i + 1], sys.maxsize) for i in range(n - 1)]
        while pair and (low := min(pair)) != sys.maxsize:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], sys.maxsize)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], sys.maxsize)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """As merge, by a heap over a linked list: n log n steps for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        start, stop, left, right = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = right[i] if stop[i] else n
            if not stop[i] or j >= n or stop[j] != e:
                continue  # one of the pair has merged since
            stop[i], stop[j], right[i] = e, 0, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(piece[start[i] : stop[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, stop[right[i]]))
            if left[i] >= 0 and (r := ranks.get(piece[start[left[i]] : e])) is not None:
                heapq.heappush(heap, (r, left[i], e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = right[i]
        return tuple(out)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text. Many short texts are pre-tokenised as one block."""
        out: list[np.ndarray] = []
        block: list[str] = []
        size = 0
        for t in texts:
            if block and size + len(t) > BLOCK:
                out += self._block(block)
                block, size = [], 0
            block.append(t)
            size += len(t)
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        ends = np.cumsum([len(t) for t in texts])
        begins = np.concatenate(([0], ends[:-1]))
        first = np.zeros(len(joined), bool)
        first[begins[begins < ends]] = True
        at = np.flatnonzero(boundaries(np.frombuffer(joined.encode("utf-32-le"), np.uint32), first))
        cuts = [*at.tolist(), len(joined)]
        ids: list[tuple[int, ...]] = []
        cache = self.cache
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = joined[a:b]
            got = cache.get(piece)
            if got is None:
                got = self.merge(piece.encode())
                if b - a <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[piece] = got
            ids.append(got)
        n = np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))))
        flat = np.fromiter((x for p in ids for x in p), np.uint32, int(n[-1]))
        of = n[np.searchsorted(at, np.concatenate((begins, ends[-1:])))]
        return [flat[a:b] for a, b in zip(of, of[1:], strict=False)]

    @property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes one after another, and where each id's begin."""
        if not hasattr(self, "_table"):
            size = max(self.pieces) + 1
            lengths = np.array([len(self.pieces.get(i, b"")) for i in range(size)], np.int64)
            self._table = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(size)), np.uint8), np.concatenate(([0], np.cumsum(lengths)))
        return self._table

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the text's bytes, and the end of the last."""
        starts = self.table[1]
        return np.concatenate(([0], np.cumsum(starts[ids.astype(np.int64) + 1] - starts[ids])))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of the tokens, each copied to its offset."""
        data, starts = self.table
        lengths = np.diff(offsets)
        return data[np.repeat(starts[ids] - offsets[:-1], lengths) + np.arange(offsets[-1])].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str = RANKS) -> Encoder:
    return Encoder(path)


#: What encode can return: Arrow type and Spark type.
OUTPUTS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "offsets": (pa.list_(pa.int64()), "array<bigint>"),
    "decoded": (pa.string(), "string"),
    "n_tokens": (pa.int64(), "bigint"),
    "ids_sha256": (pa.string(), "string"),
    "decoded_sha256": (pa.string(), "string"),
}
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _columns(texts: list[str | None], path: str, outputs: Sequence[str]) -> list[pa.Array]:
    enc, rows = encoder(path), []
    for ids in enc.encode([t or "" for t in texts]):
        offsets = enc.offsets(ids)
        raw = enc.decode(ids, offsets)
        made = {
            "ids": lambda ids=ids: ids,
            "offsets": lambda offsets=offsets: offsets,
            "decoded": lambda raw=raw: raw.decode(),
            "n_tokens": lambda ids=ids: len(ids),
            "ids_sha256": lambda ids=ids: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
            "decoded_sha256": lambda raw=raw: hashlib.sha256(raw).hexdigest(),
        }
        rows.append([made[k]() for k in outputs])
    return [pa.array([r[i] for r in rows], OUTPUTS[k][0]) for i, k in enumerate(outputs)]


def encode(df: DataFrame, text: str = "text", *, keep: Sequence[str] | None = None, path: str = RANKS, outputs: Sequence[str] = tuple(OUTPUTS)) -> DataFrame:
    """Columns `keep` of df (all without it) with `outputs` of each whole text, encoded and decoded again.

    outputs: ids; offsets (where each token begins in the text's bytes, and the end); decoded; n_tokens; SHA-256
    of the ids (little-endian unsigned 32 bit) and of the decoded bytes. A null text is encoded as an empty one:
    no ids. Columns of df with these names are replaced. Rows are handled in slices of a few million characters,
    and a long text alone.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    given = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(batch.num_columns - 1)
            while at < batch.num_rows:
                stop, size = at, 0
                while stop < batch.num_rows and (stop == at or size < 4 * BLOCK):
                    size += len(texts[stop].as_py() or "")
                    stop += 1
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *_columns(part.column(len(kept)).to_pylist(), path, outputs)], [*kept, *outputs])
                at = stop
        encoder(path).cache.clear()  # an idle worker holds the ranks only

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1]] + [f"{k} {OUTPUTS[k][1]}" for k in outputs])
    return given.mapInArrow(run, schema)
