"""URL filter: allow/block rules first, then a weighted vocabulary counted by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, fresh, quoted

# One strict term rejects, several distinct soft terms do.
STRICT_TERMS = ("spam-farm", "cheap-pills", "casino", "viagra", "cialis", "porn", "xxx", "payday-loan", "payday-loans", "warez", "phishing", "malware")
SOFT_TERMS = ("adult", "bet", "bonus", "cheap", "click", "coupon", "discount", "farm", "free", "gambling", "jackpot", "loan", "lottery", "nude", "pills", "prize", "sex", "spam", "torrent", "win")
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SOFT = 2
#: Most terms of a vocabulary, as all of them are in the memory of each task.
MAX_TERMS = 1_000_000

_TO_LOWER = str.maketrans(UPPER, LOWER)


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for t in terms:
            a.add_word(t, (weight, t))
    a.make_automaton()
    return a


def _wordy(ch: str) -> bool:
    return "0" <= ch <= "9" or "a" <= ch <= "z" or ch >= "\x80"


def term_hits(url: str | None, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """How many distinct strict and soft terms stand in the URL between boundaries (no ASCII letter, digit or non-ASCII character beside them)."""
    text = (url or "").translate(_TO_LOWER)
    found = set()
    for end, (weight, term) in automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _wordy(text[start - 1])) and (end + 1 == len(text) or not _wordy(text[end + 1])):
            found.add((weight, term))
    n_strict = sum(w for w, _ in found)
    return n_strict, len(found) - n_strict


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def filter_urls(
    df: DataFrame,
    url: str = "url",
    *,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    rules: Sequence[tuple[str, str]] = RULES,
    min_soft: int = MIN_SOFT,
) -> DataFrame:
    """df with host, path, rule, n_strict, n_soft and verdict (allow or block) of each URL.

    A rule decides where one fits (longest wins); elsewhere one strict term or `min_soft` distinct soft
    terms block. Null or no `://`: host and path empty, terms are still counted (none in null). Empty
    table: no rows. Repeated rows are judged one by one; a term counts once however often it occurs. A URL is read whole. Columns of df with these names are replaced.
    """
    s, w = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict long, n_soft long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([term_hits(u, s, w) for u in urls], columns=["n_strict", "n_soft"], dtype="int64")

    given, hits = fresh(df, "given_url", "term_hits")
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "n_strict", "n_soft")]
    out = df.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(url)).alias(given))
    out = out.withColumns({"host": host_of(F.col(given)), "path": path_of(F.col(given))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "verdict": verdict, hits: count(F.col(given))})
    by_terms = F.when((F.col(f"{hits}.n_strict") > 0) | (F.col(f"{hits}.n_soft") >= min_soft), "block").otherwise("allow")
    return out.withColumns({"n_strict": F.col(f"{hits}.n_strict"), "n_soft": F.col(f"{hits}.n_soft"), "verdict": F.coalesce("verdict", by_terms)}).drop(given, hits)


def vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, list[str]]:
    """strict and soft terms, for filter_urls, from a table whose weight column says `strict` or `soft`; lower-cased A-Z, without nulls and empty ones.

    A term that is both is strict. The vocabulary goes to the driver and to every task, so a table beyond MAX_TERMS raises.
    """
    rows = terms.select(ascii_lower(F.col(quoted(term))).alias("t"), F.col(quoted(weight)).alias("w")).where((F.col("t") != "") & F.col("w").isin("strict", "soft")).distinct().limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a vocabulary holds at most {MAX_TERMS} terms")
    strict = {r["t"] for r in rows if r["w"] == "strict"}
    return {"strict": sorted(strict), "soft": sorted({r["t"] for r in rows} - strict)}


def _term_sql(terms: Sequence[str]) -> str:
    edge = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    return " + ".join(f"CAST(regexp_matches(u, '(^|{edge}){t}($|{edge})') AS BIGINT)" for t in terms)


def oracle() -> str:
    cases, verdicts = "", ""
    for v, r in sorted(RULES, key=lambda x: (-len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{slash + p}') THEN"
        cases, verdicts = f"{cases} {fits} '{r}'", f"{verdicts} {fits} '{v}'"
    return rf"""
    WITH parsed AS (
      SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u
      FROM pages),
    counted AS (SELECT *, {_term_sql(STRICT_TERMS)} AS n_strict, {_term_sql(SOFT_TERMS)} AS n_soft FROM parsed)
    SELECT page_id, host, path, CASE{cases} END AS rule,
           CASE{verdicts} WHEN n_strict > 0 OR n_soft >= {MIN_SOFT} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
    FROM counted"""
