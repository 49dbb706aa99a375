"""Token-id output: sorted-string-table shards. Documents by id in prefix-compressed blocks, with a sparse index, a Bloom filter and a footer.

A file is: blocks, index, Bloom filter, footer. An entry of a block is three varints (bytes of the key shared with the entry before,
other bytes of the key, bytes of the value), the other bytes and the value, little-endian ids of `width` bytes. A block ends with its
CRC-32. The index has for each block its last key, offset, size, entries and the ids before it in the file. A lookup asks the Bloom
filter, searches the index by halves and reads one block.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import bounded_batches, shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, PROBES = 10, 7
MAGIC = b"TSSTAB01"
_FOOTER = struct.Struct("<QQQQQQB8s")  # index offset and size, Bloom offset and size, documents, ids, width, magic
_INDEX = struct.Struct("<QIIQH")  # offset, size, entries, ids before, key bytes
#: Bytes of text for which a shard is made, if that gives more shards than there are shuffle partitions.
SHARD_BYTES = 256 << 20
#: Words of a generation whose ids a worker remembers (it keeps two), and the longest word remembered.
CACHE, CACHED_WORD = 600_000, 64
#: ASCII punctuation but the apostrophe, and the steps of a tokenizer that cut a word between ASCII letters and such marks after them
#: and do nothing else to the letters than to lower them.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def pack_key(doc_id: int | None) -> bytes:
    """Bytes that sort as ids do; null is the empty key, before all others."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def unpack_key(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _probes(digests: bytes, bits: int) -> np.ndarray:
    """Key x probe: the bits of keys, given by their 16-byte digests."""
    a, b = np.frombuffer(digests, "<u8").reshape(-1, 2).T % np.uint64(bits)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * (b | np.uint64(1))[:, None]) % np.uint64(bits)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def write_table(out, rows: Iterable[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Writes (id, packed ids) in ascending order; returns documents and ids."""
    index, keys = [], []
    block, last, entries, at, docs, ids, before = bytearray(), b"", 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal at, entries, before
        if entries:
            raw = bytes(block) + struct.pack("<I", zlib.crc32(block))
            out.write(raw)
            index.append(_INDEX.pack(at, len(raw), entries, before, len(last)) + last)
            at, entries, before = at + len(raw), 0, ids
            block.clear()

    for doc_id, value in rows:
        key = pack_key(doc_id)
        if docs and key < last:
            raise ValueError("ids must ascend")
        shared = 0
        if entries:
            while shared < min(len(key), len(last)) and key[shared] == last[shared]:
                shared += 1
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        last, entries, docs, ids = key, entries + 1, docs + 1, ids + len(value) // width
        keys.append(_digest(key))
        if len(block) >= BLOCK_BYTES:
            flush()
    flush()
    bits = max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8)
    bloom = np.zeros(bits, np.uint8)
    for at_key in range(0, len(keys), 1 << 16):
        bloom[_probes(b"".join(keys[at_key : at_key + (1 << 16)]), bits)] = 1
    bloom = np.packbits(bloom, bitorder="little")
    packed = b"".join(index)
    out.write(packed + bloom.tobytes() + _FOOTER.pack(at, len(packed), at + len(packed), len(bloom), docs, ids, width, MAGIC))
    return docs, ids


class Table:
    """A shard on any file system that pyarrow opens: whole scans, and lookups by id."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = self._read(size - _FOOTER.size, _FOOTER.size)
        at, n, bloom_at, bloom_n, self.docs, self.ids, self.width, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no table of this format")
        self.kind = {2: "<u2", 4: "<u4"}[self.width]
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_n), np.uint8)
        raw, self.blocks, self.last = self._read(at, n), [], []
        at = 0
        while at < n:
            *where, k = _INDEX.unpack_from(raw, at)
            at += _INDEX.size
            self.blocks.append(tuple(where))
            self.last.append(raw[at : at + k])
            at += k

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def _block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, entries, _ = self.blocks[k]
        raw = self._read(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        i, key = 0, b""

        def varint() -> int:
            nonlocal i
            out = shift = 0
            while True:
                c = raw[i]
                i += 1
                out |= (c & 127) << shift
                if c < 128:
                    return out
                shift += 7

        for _ in range(entries):
            shared, own, size = varint(), varint(), varint()
            key = key[:shared] + raw[i : i + own]
            yield key, raw[i + own : i + own + size]
            i += own + size

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids of the file before it, its ids), ascending."""
        for k, (_, _, _, before) in enumerate(self.blocks):
            for key, value in self._block(k):
                ids = np.frombuffer(value, self.kind)
                yield unpack_key(key), before, ids
                before += len(ids)

    def may_hold(self, doc_id: int | None) -> bool:
        k = _probes(_digest(pack_key(doc_id)), 8 * len(self.bloom))[0].astype(np.int64)
        return bool((self.bloom[k >> 3] >> (k & 7) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents of this id (several if the table holds repeated rows)."""
        key, out = pack_key(doc_id), []
        if self.may_hold(doc_id):
            k = bisect.bisect_left(self.last, key)
            while k < len(self.blocks):
                out += [np.frombuffer(v, self.kind) for x, v in self._block(k) if x == key]
                if self.last[k] != key:
                    break
                k += 1
        return out


def _merges_alone(path: str) -> Tokenizer | None:
    """The tokenizer without the steps before its merges, if they are _STEPS and no added token is letters with marks after them."""
    whole = Tokenizer.from_file(path)
    own = json.loads(whole.to_str())
    added = [t["content"].encode() for t in own["added_tokens"]]
    if (own["normalizer"], own["pre_tokenizer"]) != _STEPS or own["model"]["type"] != "BPE" or any(not h or h.isalpha() for h in (t.rstrip(_MARKS) for t in added)):
        return None
    whole.normalizer = whole.pre_tokenizer = None
    return whole


class WordEncoder:
    """The tokenizers library over the distinct words between ASCII white space, whose ids are remembered.

    The tokenizer's own steps treat white space as a break and drop it, so the ids of a text are those of its
    words, one after another. Where its steps are _STEPS, the ids of ASCII letters with marks after them are those of the
    lowered letters, which need the tokenizer's merges alone, and those of the marks.
    """

    def __init__(self, path: str, width: int) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _merges_alone(path)
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _coded(self, tokenizer: Tokenizer, new: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word and its packed ids. One call encodes them all as words of one sequence."""
        new = list(new)
        if not new:
            return iter(())
        got = tokenizer.encode([w.decode() for w in new], is_pretokenized=True, add_special_tokens=False)
        ids, of = np.array(got.ids, self.kind), np.array(got.word_ids, np.int64)
        cuts = (np.searchsorted(of, np.arange(len(new) + 1)) * ids.itemsize).tolist()
        raw = ids.tobytes()
        return zip(new, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True)

    def _made(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of words that aren't remembered, and of their parts."""
        if self.letters is None:
            return dict(self._coded(self.tokenizer, new))
        young, old = self.young, self.old
        whole, plain = set(), []
        for w in new:
            head = w.rstrip(_MARKS)
            if head.isalpha():  # of bytes, which knows ASCII only
                plain.append((w, head.lower(), w[len(head) :]))
            else:
                whole.add(w)
        heads = {h for _, h, _ in plain}.difference(young)
        tails = {t for _, _, t in plain if t}.difference(young)
        made = {p: old[p] for s in (heads, tails) for p in s if p in old}
        made.update(self._coded(self.letters, heads.difference(old)))
        made.update(self._coded(self.tokenizer, whole | tails.difference(old)))
        made[b""] = b""
        for w, head, tail in plain:
            if w != head:
                made[w] = (made[head] if head in made else young[head]) + (made[tail] if tail in made else young[tail])
        return made

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        docs = [(t or "").encode().split() for t in texts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        far = set().union(*docs).difference(young)
        young.update((w, old[w]) for w in far if w in old)
        new = self._made(far.difference(old))
        young.update(new)
        tail = np.array([end], self.kind).tobytes()
        out = [b"".join(map(young.__getitem__, d)) + tail for d in docs]
        for w in new:
            if len(w) > CACHED_WORD:
                del young[w]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, width: int) -> WordEncoder:
    return WordEncoder(path, width)


def write_shards(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end: int = END_ID, shards: int | None = None) -> list[dict]:
    """Encodes every whole text, appends `end` and writes the documents in ascending order of id to shards in `folder`.

    Returns the manifest, one entry for each shard that has documents: path, first and last id, docs, ids and
    start (ids in the shards before). There are as many shards as shuffle partitions, and more if they would hold more than
    SHARD_BYTES of text each. Ids are dealt to them by quantiles of the id column, so only encoded ids are shuffled, once. A task writes a file of its own name and renames it when it is whole; a
    repeated task replaces it by an equal one. Null texts are empty ones. A null id sorts first; repeated ids
    stay together in one shard, ordered by their ids' bytes. A text is encoded whole, however long. An empty table makes no shard.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if not (n := shards):
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // SHARD_BYTES))
    cuts = docs.select(F.percentile_approx(F.col(doc_id).cast("long"), [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = part.column(0).to_pylist()
                shard = [0 if k is None else int(np.searchsorted(bounds, k, "left")) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), part.column(0), pa.array(enc.encode(part.column(1).to_pylist(), end), pa.binary())], ["shard", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = []

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for s, k, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    seen[:] = [s, seen[1] if seen else k, k]
                    yield k, v

        given = rows()
        head = next(given, None)
        if head is None:
            return
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        own = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            count, ids = write_table(out, _after(head, given), width)
        name = f"shard-{seen[0]:05d}.sst"
        fs.move(own, f"{path}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((seen[0], pa.int32()), (f"{folder}/{name}", pa.string()), (seen[1], pa.int64()), (seen[2], pa.int64()), (count, pa.int64()), (ids, pa.int64()))], ["shard", "path", "first", "last", "docs", "ids"])

    coded = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    found = sorted((r.asDict() for r in dealt.mapInArrow(store, "shard int, path string, first long, last long, docs long, ids long").collect()), key=lambda r: r["shard"])
    start = 0
    for r in found:  # one row for each shard
        r["start"], start = start, start + r["ids"]
    return found


def _after(head, rest: Iterator) -> Iterator:
    yield head
    yield from rest


def read_shards(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, read from the files: start counts the ids of all documents before it."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
    return _read(spark, manifest, schema, True)


def digests(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """read_shards without the ids."""
    return _read(spark, manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", False)


def _read(spark: SparkSession, manifest: list[dict], schema: str, whole: bool) -> DataFrame:
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for k, before, ids in Table(path).scan():
                    rows.append((k, start + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids] if whole else [])))
                    size += len(ids)
                    if len(rows) >= 4096 or size >= 1 << 21:
                        yield _batch(rows, whole)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, whole)

    shards = spark.createDataFrame([(r["path"], r["start"]) for r in manifest], "path string, start long")
    return shards.repartition(max(1, len(manifest))).mapInArrow(load, schema)


def _batch(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + ([pa.list_(pa.int32())] if whole else [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if whole else [])])


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs (doc_id, text) to a new folder beside the checkpoints and reads the files' digests."""
    spark = docs.sparkSession
    return digests(spark, write_shards(docs, shared_dir(spark)))
