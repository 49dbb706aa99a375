"""The pipeline's stages on edge cases, and its rows against brute force."""

import hashlib
import re

import corpus_pipeline as p
import duckdb
import pytest
from tessera.llm import bpe, decontam, langid, neardup, secrets


def test_every_stage_takes_odd_and_empty_tables(spark, sf, odd, empty):
    for docs in (odd, empty):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
        assert p.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_rows_equal_brute_force(spark, sf):
    con = duckdb.connect()
    docs = {r[0]: r[1] for r in con.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    model = langid.train(langid.training_rows(spark.read.parquet(f"{sf}/documents.parquet")))
    kept = {i: t for i, t in docs.items() if (g := model.predict(t))[0] != "und" and g[1] >= 0.5}
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in kept.items()}
    comp = {i: i for i in kept}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(kept)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    kept = {i: t for i, t in kept.items() if root(i) == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = {tuple(w[i : i + n]) for r in con.sql(f"select text from '{sf}/benchmark.parquet'").fetchall() for w in [words(r[0] or "")] for n in [min(13, len(w))] if n for i in range(len(w) - n + 1)}
    lengths = {len(g) for g in grams}

    def bad(t):
        w = words(t)
        hit = {k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(i, i + n)}
        return bool(hit) and decontam.RATIO * len(hit) >= len(w)

    kept = {i: t for i, t in kept.items() if not bad(t)}
    scorer, enc = secrets.train(), bpe.Encoder()
    texts = {i: secrets.redact(t, secrets.find(t, scorer)) for i, t in kept.items()}
    want = {i: hashlib.sha256(enc.encode([t])[0].astype("<u4").tobytes()).hexdigest() for i, t in texts.items()}
    got = p.run(spark, sf).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == want
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_stage_names(name):
    assert re.fullmatch(r"[a-z_]+", name)
