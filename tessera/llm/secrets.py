"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials that score all other candidates."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automata import Automaton, infer
from tessera.llm.common import bounded_batches, fresh, quoted

BASE_KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGNED = 8
#: What is scored: runs of credential characters, and their parts that start after a sign. No format has fewer characters than these.
MIN_CANDIDATE = 16
_SIGNS = "+/_.=-"
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_CANDIDATE},}}")
#: Signs in a run from which hopeless starts are sorted out first; the hits are the same.
MANY_STARTS = 32
#: Bits by which a format must explain a candidate better than ordinary text, in all and for each character.
MIN_BITS, MIN_BITS_PER_CHAR = 24.0, 0.5
EXAMPLES, SEED = 300, 11

_UPPER, _LOWER, _DIGIT = string.ascii_uppercase, string.ascii_lowercase, string.digits
_ALNUM = _UPPER + _LOWER + _DIGIT
# Published credential formats as (text, or (alphabet, length or lengths)) parts.
FORMATS: dict[str, tuple] = {
    "aws-temporary": ("ASIA", (_UPPER + "234567", 16)),
    "github": ("gh", ("pousr", 1), "_", (_ALNUM, 36)),
    "github-fine": ("github_pat_", (_ALNUM, 22), "_", (_ALNUM, 59)),
    "gitlab": ("glpat-", (_ALNUM + "-_", 20)),
    "google": ("AIza", (_ALNUM + "-_", 35)),
    "hex-upper": ((_DIGIT + "ABCDEF", (32, 40, 64)),),
    "jwt": ("eyJhbGciOi", (_ALNUM, (10, 26)), ".eyJ", (_ALNUM + "-_", (30, 80, 160, 320, 640)), ".", (_ALNUM + "-_", (43, 64, 86, 342, 683))),
    "npm": ("npm_", (_ALNUM, 36)),
    "sendgrid": ("SG.", (_ALNUM + "-_", 22), ".", (_ALNUM + "-_", 43)),
    "slack": ("xox", ("abprs", 1), "-", (_DIGIT, 12), "-", (_DIGIT, 12), "-", (_ALNUM, 24)),
    "stripe": (("rs", 1), "k_live_", (_ALNUM, (24, 34))),
}
KINDS = (*BASE_KINDS, *FORMATS)


def labelled_credentials(n: int = EXAMPLES, seed: int = SEED) -> dict[str, list[str]]:
    """n examples of each format, made by its published rule; and of `ordinary` text that has the same characters."""
    r = random.Random(seed)

    def draw(parts: tuple) -> str:
        out = ""
        for p in parts:
            out += p if isinstance(p, str) else "".join(r.choices(p[0], k=p[1] if isinstance(p[1], int) else r.choice(p[1])))
        return out

    syllables = ("an", "er", "ion", "the", "re", "ti", "es", "or", "con", "de", "la", "ment", "ung", "ver", "sch", "que")
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 5)))
    ordinary = [r.choice((word(), word().title(), word().upper(), str(r.randint(0, 10**6)), f"{word()}.{word()}{r.randint(0, 99)}.com/{word()}", f"{word()}_{word()}-{r.randint(1, 2100)}", f"{word()}/{word()}={r.randint(0, 9)}")) for _ in range(10 * n)]
    return {k: [draw(parts) for _ in range(n)] for k, parts in FORMATS.items()} | {"ordinary": ordinary}


@dataclass(frozen=True)
class Scorer:
    """One automaton for each format, and log2 frequencies of ordinary characters after one another."""

    formats: tuple[tuple[str, Automaton], ...]
    ordinary: dict[tuple[str, str], float]

    def background(self, s: str) -> float:
        worst = -12.0
        return sum(self.ordinary.get((a, b), worst) for a, b in zip(" " + s, s, strict=False))

    def best(self, s: str) -> tuple[str | None, float]:
        """The most likely format and the bits by which it beats ordinary text; None where none does by enough."""
        base, found = None, (-math.inf, "")
        for kind, automaton in self.formats:
            if (p := automaton.log2_likelihood(s)) > -math.inf:
                base = self.background(s) if base is None else base
                found = max(found, (p - base, kind))
        return (found[1] if _enough(found[0], len(s)) else None), found[0]

    def longest(self, s: str, at: int) -> tuple[int, str] | None:
        """End and format of the part of s from `at` that beats ordinary text by the most bits; it ends with s or before a sign."""
        found = (-math.inf, 0, "")
        for kind, automaton in self.formats:
            base, before = 0.0, " "
            for k, p, stop in automaton.walk(s, at):
                base += self.ordinary.get((before, s[k - 1]), -12.0)
                before = s[k - 1]
                if k - at >= MIN_CANDIDATE and (k == len(s) or s[k] in _SIGNS) and _enough(p + stop - base, k - at):
                    found = max(found, (p + stop - base, k, kind))
        return found[1:] if found[2] else None


    def hopeful(self, s: str) -> list[bool]:
        """Whether a part of s from each place can be enough for any format, by the most that its best way on may bring; one pass back."""
        out = [False] * len(s)
        for _, automaton in self.formats:
            states = range(len(automaton.stop))
            bits, rest = list(automaton.stop), list(automaton.stop)  # the most from the place after, in all and beyond MIN_BITS_PER_CHAR
            for k in range(len(s) - 1, -1, -1):
                ways = [automaton.way(q, s[k]) for q in states]
                if ways[0]:
                    to, p = ways[0]
                    p -= self.ordinary.get((" ", s[k]), -12.0)
                    out[k] |= p + bits[to] >= MIN_BITS - 1e-6 and p - MIN_BITS_PER_CHAR + rest[to] >= -1e-6
                base = self.ordinary.get((s[k - 1], s[k]), -12.0) if k else 0.0
                bits = [max(automaton.stop[q], w[1] - base + bits[w[0]]) if w else automaton.stop[q] for q, w in enumerate(ways)]
                rest = [max(automaton.stop[q], w[1] - base - MIN_BITS_PER_CHAR + rest[w[0]]) if w else automaton.stop[q] for q, w in enumerate(ways)]
        return out


def _enough(bits: float, n: int) -> bool:
    return bits >= max(MIN_BITS, MIN_BITS_PER_CHAR * n)


@lru_cache(maxsize=4)
def train(n: int = EXAMPLES, seed: int = SEED) -> Scorer:
    labelled = labelled_credentials(n, seed)
    pairs: dict[tuple[str, str], int] = {}
    firsts: dict[str, int] = {}
    for s in labelled["ordinary"]:
        for a, b in zip(" " + s, s, strict=False):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            firsts[a] = firsts.get(a, 0) + 1
    chars = sorted(set(_ALNUM + "+/_.=-"))
    ordinary = {(a, b): math.log2((pairs.get((a, b), 0) + 0.5) / (firsts.get(a, 0) + 0.5 * len(chars))) for a in [" ", *chars] for b in chars}
    return Scorer(tuple((k, infer(labelled[k])) for k in FORMATS), ordinary)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _outside(a: int, b: int, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What the spans of `base`, sorted by their starts, leave of [a, b)."""
    for x, y, _ in base:
        if a < y and x < b:
            if a < x:
                yield a, x
            a = max(a, y)
    if a < b:
        yield a, b


def _hits(s: str, scorer: Scorer) -> Iterator[tuple[int, int, str]]:
    """The credentials of a run, leftmost and non-overlapping: all that is left of it, or the best part from a start or after a sign."""
    # a run may end in a stop or start with a quoted key; the credential itself has neither
    at, whole = 0, len(s.rstrip(".=-/+"))
    # without this, a long run of many starts would be walked from each of them
    hopeful = scorer.hopeful(s) if sum(map(s.count, _SIGNS)) > MANY_STARTS else None
    while whole - at >= MIN_CANDIDATE:
        if s[at] in _SIGNS or (at and s[at - 1] not in _SIGNS) or (hopeful and not hopeful[at]):
            at += 1
        elif kind := scorer.best(s[at:whole])[0]:
            yield at, whole, kind
            return
        elif part := scorer.longest(s, at):
            yield at, *part
            at = part[0]
        else:
            at += 1


def find(text: str | None, scorer: Scorer) -> list[tuple[int, int, str]]:
    """All spans of a whole text: the base ones, and the credentials in what they leave of each run of candidate characters."""
    text = text or ""
    base = base_spans(text)
    out = list(base)
    for m in _CANDIDATE.finditer(text):
        for a, b in _outside(m.start(), m.end(), base):
            out += [(a + x, a + y, kind) for x, y, kind in _hits(text[a:b], scorer)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, text: str = "text", scorer: Scorer | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """df with n_assign, n_access, n_hex, base_sha256, spans and redacted (or their `names`) of each whole text.

    spans: kind:start:end in code points, comma-joined; redacted: the text with each span replaced by
    [kind], overlapping ones as the first of them. A null text is searched as an empty one and stays null. A text is
    searched whole, however long, in memory that grows with its longest run. Of formats that explain a part equally well the
    last in order of name is taken; of equal parts the longest. Repeated rows are searched one by one; an empty table gives no
    rows. Columns of df with these names are replaced; all others stay.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(scorer or train())

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_row(t, shared.value) for t in texts], columns=list(_COLUMNS))

    new = {c: (names or {}).get(c, c) for c in _COLUMNS}
    (found,) = fresh(df, "secrets_found")
    out = df.select(*[F.col(quoted(c)) for c in df.columns if c not in new.values()], of(F.col(quoted(text))).alias(found))
    return out.select("*", *[F.col(f"{found}.{c}").alias(k) for c, k in new.items()]).drop(found)


def without_secrets(docs: DataFrame, text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """docs with each secret in `text` replaced by its kind in brackets; all else stays, whatever its name, and so do null and empty texts."""
    new = dict(zip(_COLUMNS, fresh(docs, *_COLUMNS), strict=True))
    found = scan(docs, text, scorer, new)
    return found.select(*[F.col(new["redacted"]).alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])


_COLUMNS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")


def _row(text: str | None, scorer: Scorer) -> tuple:
    spans = find(text, scorer)
    base = [x for x in spans if x[2] in BASE_KINDS]
    n = [sum(x[2] == k for x in base) for k in BASE_KINDS]
    return (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), redact(text, spans))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
