"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL-proximal and calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fresh, held_out, own, quoted

UNDETERMINED = "und"
#: Lengths of the n-grams, and bits of the space they are hashed into.
NGRAMS, BITS = (1, 2, 3), 15
#: About how many labelled documents the classifier is fitted on, and the most n-grams of theirs; n-gram document counts cover all training documents.
MAX_TRAINING_DOCS, MAX_TRAINING_GRAMS = 4000, 8_000_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 3
#: One training document in so many calibrates the temperature and doesn't move weights.
CALIBRATION = 5
#: Characters of a batch that are hashed at once.
SLICE = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def _codes(text: str) -> np.ndarray:
    """Code points of a text: letters' case folded away, each run of non-letters one space."""
    low = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower())
    return np.frombuffer(f" {low.strip()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)


def ngram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed character n-grams of a whole text, in blocks of bounded size."""
    c = _codes(text)
    total = np.zeros(1 << bits, np.int64) if len(c) > SLICE else None
    found: list[np.ndarray] = []
    for n in NGRAMS:
        for at in range(0, max(0, len(c) - n + 1), SLICE):
            part = c[at : at + SLICE + n - 1]
            h = np.full(len(part) - n + 1, n, np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + part[k : len(part) - n + 1 + k]
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            if total is None:
                found.append(h)
            else:
                total += np.bincount(h.astype(np.int64), minlength=1 << bits)
    if total is None:
        total = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at]


def tf_idf(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length (1 + ln tf) * idf of the buckets that training documents hold."""
    at, n = counts
    v = (1 + np.log(n)) * idf[at]
    at, v = at[v > 0], v[v > 0]
    return at, v / (np.sqrt((v * v).sum()) or 1.0)


@dataclass(frozen=True)
class Model:
    """languages: sorted label values; idf: per bucket, 0 where unseen; weights: bucket x language, mostly zero."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        at, v = tf_idf(counts, self.idf)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its calibrated probability; `und` and 0 for a text that is null or has no letter."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(ngram_counts(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal with elastic-net penalties; the last coordinate is the unpenalised bias."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, l1 = z[at], np.where(at < buckets, L1, 0.0)[:, None]
        w = -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, v = np.append(rows[i][0], buckets), np.append(rows[i][1], 1.0)
            w = weights(at)
            g = softmax(v @ w)
            g[y[i]] -= 1.0
            g = v[:, None] * g
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss on documents that moved no weight, by golden section over its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    a, b, r = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            n[ngram_counts(text.as_py())[0]] += 1
            total += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], total))], ["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
    for batch in batches:
        rows = [ngram_counts(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), *[pa.array(c, kind.field(i + 2).type) for i, c in enumerate(zip(*rows, strict=True))]], schema=kind)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, aside: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and bias from the rows that aren't set aside (from all if none is left), and the temperature by those that are."""
    learn = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    w, b = fit_ftrl([rows[i] for i in learn], y[learn], classes, 1 << BITS)
    logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(aside)]).reshape(-1, classes)
    return w, b, fit_temperature(logits, y[aside])


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = MAX_TRAINING_DOCS, max_grams: int = MAX_TRAINING_GRAMS) -> Model:
    """A model of all labels, from rows with text and label; rows where either is null or the text has no letter teach nothing.

    Inverse document frequencies count all rows. The weights are fitted on a bounded sample: about `max_docs` rows, as
    many of each label and one at least, chosen by a hash of key and text, equal rows once; and of those, by the hash, as
    many as hold `max_grams` n-grams. They are fitted in one task, which holds the sample's n-grams (8 bytes each) and two
    numbers for each bucket and label, and only the weights come to the driver. A null or repeated key chooses by the text.
    With no row, the model knows no label and predicts `und`.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(key)).cast("string").alias("key"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang", F.xxhash64("key", "text").alias("h"))
    counts = dict(map(tuple, rows.select("text").mapInArrow(_document_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()))  # one row for each bucket
    sizes = dict(map(tuple, rows.groupBy("lang").count().collect()))  # one row for each label
    idf = np.zeros(1 << BITS, np.float32)
    if not sizes:
        return Model((), idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    languages, docs, each = tuple(sorted(sizes)), counts.pop(-1), max(1, max_docs // len(sizes))
    at = np.fromiter(counts, np.int64, len(counts))
    idf[at] = np.log((1 + docs) / (1 + np.fromiter(counts.values(), np.float64, len(counts)))) + 1
    # a threshold on the hash keeps about `each` rows of a label; a label of few rows keeps all
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.0 if n <= 2 * each + 20 else each / n)])
    picked = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40)).dropDuplicates(["h", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats, y, aside, grams = [], [], [], 0
        for b in batches:
            for h, k, buckets, n in zip(b.column("h").to_pylist(), b.column("lang").to_pylist(), b.column("at"), b.column("n"), strict=True):
                if feats and grams + len(buckets) > max_grams:
                    break
                grams += len(buckets)
                at, v = tf_idf((buckets.values.to_numpy(), n.values.to_numpy()), idf)
                feats.append((at, v.astype(np.float32)))
                y.append(languages.index(k))
                aside.append(h // (1 << 40) % CALIBRATION == 0)
        w, b, t = fit(feats, np.array(y), np.array(aside), len(languages))
        used = np.flatnonzero(w.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32)]), pa.array([w[used].astype(np.float32).tobytes()]), pa.array([b]), pa.array([t])], ["at", "w", "b", "t"])

    order = picked.mapInArrow(_features, "h long, lang string, at array<int>, n array<int>").repartition(1).sortWithinPartitions("h", "lang")
    got = order.mapInArrow(run, "at array<int>, w binary, b array<double>, t double").first()
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    weights[np.array(got["at"], np.int64)] = np.frombuffer(got["w"], np.float32).reshape(-1, len(languages))
    return Model(languages, idf, weights, np.array(got["b"]), got["t"])


def predict(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with the language and its probability (0 to 1) of each whole text, in columns of these names.

    `und` and 0 where the text is null, empty or has no letter, or the model knows no label. Of labels of equal
    probability the first in order is taken. Only the text is read, whole, in blocks of bounded size however long it is.
    Repeated rows are judged one by one; an empty table gives no rows. Columns of df with these names are replaced; all others stay.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets x labels

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    (found,) = fresh(df, "lang_of_text")
    out = df.select(*[F.col(quoted(c)) for c in df.columns if c not in names], of(F.col(quoted(text))).alias(found))
    return out.select("*", *[F.col(f"{found}.{c}").alias(k) for c, k in zip(("lang_pred", "score"), names, strict=True)]).drop(found)


def training_rows(docs: DataFrame, folds: int = 5) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), folds))


def accepted(lang_pred: Column, score: Column, min_score: float = 0.5) -> Column:
    """What a corpus keeps: a determined language, predicted with at least `min_score`."""
    return (lang_pred != UNDETERMINED) & (score >= min_score)


def accept(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language the model determines with at least `min_score`, their columns, of any names, untouched."""
    pred, score = fresh(docs, "lang_pred", "lang_score")
    return predict(docs, model, text, (pred, score)).where(accepted(F.col(pred), F.col(score), min_score)).select(*own(docs))
