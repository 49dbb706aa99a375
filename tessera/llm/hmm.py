"""Language model: a hidden Markov model over word groups, trained by Baum-Welch counts summed across partitions; exact scaled forward scores.

A state emits a group of words, and the group one of its words (or, once, a word it doesn't know) by smoothed corpus counts.
Frequent words are groups of their own, the others share groups by their endings. So what the states learn is bounded, and the
vocabulary, which grows with the corpus, stays in a table that is joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, held_out, written

STATES, ITERATIONS, SEED = 4, 4, 3
#: Pseudo-counts by which a state first prefers to stay.
STICK = 40
#: Groups of the most frequent words, of word endings, and the end's.
OWN_GROUPS, ENDINGS = 256, 255
GROUPS = OWN_GROUPS + ENDINGS + 1
END = GROUPS - 1
#: Bytes of a word that say which ending it has.
ENDING = 3
#: Most words, the most frequent, whose counts go to every task; all others are joined. Counts are ranked in so many steps for each doubling.
SHARED_WORDS, STEPS = 20_000, 16
#: Distinct words that a task counts before it passes the counts on.
PARTIAL_WORDS = 300_000
SMOOTHING, EMISSION_SMOOTHING = 0.1, 0.1
#: Tokens of a block, whose transfer matrix carries states from one block of a document to the next; tokens after which its scale is taken out.
BLOCK, SCALED = 64, 16
#: As SCALED, in training, where numbers are products of two.
RESCALED = 4
#: Tokens whose blocks are in memory at once.
TOKENS = 1 << 19
FOLDS = 10


@dataclass(frozen=True)
class Vocabulary:
    """tokens (N) and types (V) of the training documents, the end among them; how often the end occurs; the shared words' counts; of each group its tokens and types."""

    tokens: int
    types: int
    ends: int
    counts: dict[bytes, int]
    own: dict[bytes, int]
    group_tokens: np.ndarray
    group_types: np.ndarray

    def group(self, word: bytes) -> int:
        g = self.own.get(word)
        return OWN_GROUPS + zlib.crc32(word[-ENDING:]) % ENDINGS if g is None else g


def tokens(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased. Both methods of bytes know ASCII only."""
    return (text or "").encode().lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(n.values(), pa.int64())], ["word", "c"])

    n: Counter = Counter()
    for batch in batches:
        for t in batch.column(0):
            n.update(tokens(t.as_py()))
            if len(n) >= PARTIAL_WORDS:
                yield flush()
                n.clear()
    yield flush()


def count_words(train: DataFrame) -> DataFrame:
    """(word, c) over all training texts, counted within tasks first."""
    return train.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """Bounded statistics of the counts table.

    Shared are all words above a count, the least by which they are not too many, so that only they come to the driver. Equal
    counts are ordered by the word.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * STEPS)
    least, many = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # at most 64 x STEPS rows
        many += r[1]
        if many > SHARED_WORDS:
            break
        least = r[0]
    top = [] if least is None else [(r["word"].encode(), r["c"]) for r in counts.where(step >= least).collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    own = {w: i for i, (w, _) in enumerate(top[:OWN_GROUPS])}
    bare = Vocabulary(0, 0, ends, {}, own, np.zeros(GROUPS), np.zeros(GROUPS))

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
        for b in batches:
            g = np.fromiter((bare.group(w.as_py().encode()) for w in b.column(0)), np.int64, b.num_rows)
            n += np.bincount(g, b.column(1).to_numpy(zero_copy_only=False), GROUPS).astype(np.int64)
            v += np.bincount(g, minlength=GROUPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS, dtype=np.int32)), pa.array(n), pa.array(v)], ["g", "n", "v"])

    n, v = np.zeros(GROUPS, np.int64), np.zeros(GROUPS, np.int64)
    for r in counts.select("word", "c").mapInArrow(by_group, "g int, n long, v long").groupBy("g").agg(F.sum("n"), F.sum("v")).collect():
        n[r[0]], v[r[0]] = r[1], r[2]
    return Vocabulary(int(n.sum()) + ends, int(v.sum()) + (ends > 0), ends, dict(top), own, n, v)


_END = np.array([END], "<u2").tobytes()


class _Groups(dict):
    """Groups of words, remembered up to a bound."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[word] = self.vocab.group(word)
        return k


class _Logs(dict):
    """What shared words add to a sum of logarithms; other words add nothing here."""

    def __missing__(self, word: bytes) -> float:
        return 0.0


_ENCODED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("groups", pa.binary()), ("known", pa.int64()), ("logs", pa.float64()), ("rest", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Of each document (doc_id, text, held_out): its groups as 16-bit numbers, what the shared words add to the sums, and its other words with how often each occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # bounded by SHARED_WORDS and GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        groups, logs = _Groups(v), _Logs({w: float(np.log10(c + SMOOTHING)) for w, c in v.counts.items()})
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in range(6)]
                for t in part.column("text"):
                    ws = tokens(t.as_py())
                    rest = [w for w in ws if w not in logs]
                    times = Counter(rest)
                    g = np.fromiter(map(groups.__getitem__, ws), "<u2", len(ws)).tobytes() + _END
                    made = (len(ws) + 1, g, len(ws) - len(rest) + (v.ends > 0), sum(map(logs.__getitem__, ws)), [w.decode() for w in times], list(times.values()))
                    for c, x in zip(cols, made, strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *[pa.array(c, f.type) for c, f in zip(cols, list(_ENCODED)[2:], strict=True)]], schema=_ENCODED)

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, groups binary, known long, logs double, rest array<string>, times array<int>")


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # state x group


def initial(group_tokens: np.ndarray, ends: int) -> Hmm:
    """Corpus frequencies of the groups, unsettled so that the states can part, and states that rather stay."""
    r = np.random.default_rng(SEED)
    base = group_tokens + EMISSION_SMOOTHING
    base[END] += ends
    emit = base * (r.gamma(0.5, 1, (STATES, GROUPS)) + 0.02)
    move = r.uniform(0.5, 1.5, (STATES, STATES)) + STICK * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _blocks(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut into rows of BLOCK tokens: (groups, with -1 after the end), lengths, and whether a row begins a document."""
    rows = [-(-len(d) // BLOCK) for d in docs]
    grid = np.full((sum(rows), BLOCK), -1, np.int32)
    at = 0
    first = np.zeros(len(grid), bool)
    for d, k in zip(docs, rows, strict=True):
        grid[at : at + k].reshape(-1)[: len(d)] = d
        first[at] = True
        at += k
    return grid, (grid >= 0).sum(1), first


def _transfers(model: Hmm, grid: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the scaled product of its tokens' transfer matrices and the logarithm of the scale. A document's first token follows none."""
    order = np.argsort(-n, kind="stable")
    tokens, sizes = grid[order].T, -n[order]
    m, scale, emit = np.tile(np.eye(STATES), (len(grid), 1, 1)), np.zeros(len(grid)), model.emit.T
    for t in range(int(n.max(initial=0))):
        k = int(np.searchsorted(sizes, -t))  # rows longer than t
        x = (m[:k].reshape(-1, STATES) @ model.move).reshape(-1, STATES, STATES)
        if t == 0:
            x[first[order]] = np.eye(STATES)
        x *= emit[tokens[t, :k]][:, None, :]
        m[:k] = x
        if t % SCALED == SCALED - 1 or t == BLOCK - 1:
            top = x.max((1, 2))
            m[:k] /= top[:, None, None]
            scale[:k] += np.log(top)
    out, logs = np.empty_like(m), np.empty_like(scale)
    out[order], logs[order] = m, scale
    return out, logs


def _chained(model: Hmm, m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (each row's distribution after the row before it, given all tokens so far; the start for a document's first), the
    logarithms of the rows' scales, and the weight of each state at a row's end by all tokens after it."""
    begins = np.flatnonzero(first)
    rows = np.diff(np.append(begins, len(m)))
    before, after, logs = np.tile(model.start, (len(m), 1)), np.ones((len(m), STATES)), np.zeros(len(m))
    order = np.argsort(-rows, kind="stable")
    sizes = -rows[order]
    live = [begins[order[: int(np.searchsorted(sizes, -step))]] + step for step in range(int(rows.max(initial=0)))]  # the rows of that number
    for step, at in enumerate(live):
        x = np.einsum("ds,dst->dt", before[at], m[at])
        total = x.sum(1)
        logs[at] = np.log(total)
        if step + 1 < len(live):
            k = len(live[step + 1])
            before[live[step + 1]] = x[:k] / total[:k, None]
    for at in reversed(live[1:]):
        x = np.einsum("dst,dt->ds", m[at], after[at])
        after[at - 1] = x / x.sum(1, keepdims=True)
    return before, logs, after


def expected_counts(model: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Baum-Welch counts of whole documents: starts, moves and emissions, one after another. States are carried over the blocks' ends both ways."""
    grid, n, first = _blocks(docs)
    if (~first).any():
        before, _, after = _chained(model, _transfers(model, grid, n, first)[0], first)
    else:
        before, after = np.tile(model.start, (len(grid), 1)), np.ones((len(grid), STATES))
    order = np.argsort(-n, kind="stable")
    grid, n, first, before, after = grid[order], n[order], first[order], before[order], after[order]
    emit = model.emit.T
    live = [int(np.searchsorted(-n, -t)) for t in range(BLOCK)]  # rows longer than t
    a = np.zeros((BLOCK, len(grid), STATES))
    b = np.ones((BLOCK, len(grid), STATES))
    e = emit[np.maximum(grid, 0).T]  # time x row x state
    a[0] = np.where(first[:, None], before, before @ model.move) * e[0]
    a[0] /= a[0].sum(1, keepdims=True)
    for t in range(1, BLOCK):
        k = live[t]
        if not k:
            break
        np.matmul(a[t - 1, :k], model.move, out=a[t, :k])
        a[t, :k] *= e[t, :k]
        if t % RESCALED == 0:
            a[t, :k] /= a[t, :k].sum(1, keepdims=True)
    moves = np.zeros((STATES, STATES))
    b[BLOCK - 1] = np.where((n == BLOCK)[:, None], after, 1.0)
    for t in range(BLOCK - 1, 0, -1):
        k = live[t]
        if not k:
            continue
        eb = e[t, :k] * b[t, :k]
        x = eb @ model.move.T
        moves += (a[t - 1, :k] / np.einsum("rs,rs->r", a[t - 1, :k], x)[:, None]).T @ eb
        b[t - 1, :k] = x / x.sum(1, keepdims=True) if t % RESCALED == 0 else x
    inner = ~first
    eb = e[0, inner] * b[0, inner]
    moves += (before[inner] / (before[inner] * (eb @ model.move.T)).sum(1, keepdims=True)).T @ eb
    at = grid.T.reshape(-1)
    ok = np.flatnonzero(at >= 0)
    a *= b
    starts = a[0][first]
    flat = a.reshape(-1, STATES)[ok]
    flat /= flat.sum(1, keepdims=True)
    out = np.stack([np.bincount(at[ok], flat[:, s], GROUPS) for s in range(STATES)])
    return np.concatenate([(starts / starts.sum(1, keepdims=True)).sum(0), (moves * model.move).reshape(-1), out.reshape(-1)])


def reestimate(counts: np.ndarray) -> Hmm:
    start, move, emit = np.split(counts, [STATES, STATES + STATES**2])
    start, move, emit = start + EMISSION_SMOOTHING, move.reshape(STATES, STATES) + EMISSION_SMOOTHING, emit.reshape(STATES, GROUPS) + EMISSION_SMOOTHING
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def forward(model: Hmm, docs: list[np.ndarray]) -> np.ndarray:
    """Exact natural log probability of each sequence of groups: scaled transfer matrices of blocks, chained along each document."""
    grid, n, first = _blocks(docs)
    m, scale = _transfers(model, grid, n, first)
    _, logs, _ = _chained(model, m, first)
    return np.add.reduceat(logs + scale, np.flatnonzero(first)) if len(docs) else np.zeros(0)


def _sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            docs: list[np.ndarray] = []
            size, begin = 0, at
            while at < batch.num_rows and (not docs or size < TOKENS):
                docs.append(np.frombuffer(batch.column(column)[at].as_py(), "<u2"))
                size += len(docs[-1])
                at += 1
            yield batch.slice(begin, at - begin), docs


def train(encoded: DataFrame, vocab: Vocabulary, iterations: int = ITERATIONS) -> Hmm:
    """Baum-Welch over all training documents; each round's counts are summed within tasks, then across them."""
    model = initial(vocab.group_tokens.astype(np.float64), vocab.ends)
    rows = encoded.where(~F.col("held_out")).select("groups")
    for _ in range(iterations):
        shared = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + STATES * GROUPS)
            for _, docs in _sliced(batches, "groups"):
                total += expected_counts(shared.value, docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

        counts = np.zeros(STATES + STATES**2 + STATES * GROUPS)
        for r in rows.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():
            counts[r[0]] = r[1]
        model = reestimate(counts)
    return model


def scores(encoded: DataFrame, vocab: Vocabulary, model: Hmm) -> DataFrame:
    """encoded's rows without groups, with the log10 probability of the groups and of the words' share that is the groups' alone."""
    shared = encoded.sparkSession.sparkContext.broadcast((model, np.append(np.log10(vocab.group_tokens[:END] + SMOOTHING * (vocab.group_types[:END] + 1)), 0.0)))
    kept = ["rid", "doc_id", "held_out", "n_tokens", "known", "logs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, norms = shared.value
        for part, docs in _sliced(batches, "groups"):
            of_groups = forward(model, docs) / np.log(10)
            within = np.array([-norms[d].sum() for d in docs])
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], pa.array(of_groups + within)], [*kept, "of_groups"])

    return encoded.select(*kept, "groups").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, of_groups double")


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Documents whose crc32(id as text) mod `folds` is 0 are held out of all training; a null id isn't. A null
    text is an empty one: its only token is the end. With no training document all words are unknown and
    the states keep their first guess. Repeated rows count as often as they occur; an empty table gives no rows. Words of equal
    counts are ranked by their bytes. Training and scoring take whole documents: a long one is cut into blocks over whose ends
    states are carried, and is in memory as a whole (about 200 bytes a token in training). Scores are log10. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id), folds).alias("held_out"))
    learning = given.where(~F.col("held_out"))
    counts = written(count_words(learning))
    vocab = vocabulary(counts, learning.count())
    encoded = written(encode(given, vocab).withColumn("rid", F.monotonically_increasing_id()))
    model = train(encoded, vocab)
    pairs = encoded.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("rid", F.col("x.rest").alias("word"), F.col("x.times").alias("k"))
    rest = pairs.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("far_logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("far_known"))
    logs = F.col("logs") + F.coalesce("far_logs", F.lit(0.0))
    end = float(np.log10(vocab.ends + SMOOTHING))
    norm = float(np.log10(vocab.tokens + SMOOTHING * (vocab.types + 1)))
    return scores(encoded, vocab, model).join(rest, "rid", "left").select(
        F.col("doc_id").alias(doc_id),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (logs + end - F.col("n_tokens") * norm).alias("base_score"),
        (logs + F.col("of_groups")).alias("score"),
    )
