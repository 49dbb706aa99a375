"""Decontamination, quality and licence operators: SQL on whole tables, edge cases by hand."""

import os
import random
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, licenses, quality, registry
from tessera.llm.common import window_hashes, words


def sql(sf, text):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con.sql(text).df()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, sf, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), sql(sf, registry.oracle_sql()[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda df: sorted(tuple("-" if x is None or x != x else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [("long", "a b c d e f g h i j k l m n"), ("short", "Quick, brown"), ("none", "!!"), ("null", None)]
    return spark.createDataFrame(rows, "item_id string, text string")


def test_windows_of_short_and_long_items(spark, bench):
    docs = spark.createDataFrame([(1, "z a b c d e f g h i j k l m z"), (2, "the quick brown fox"), (3, "quick fox brown"), (4, None), (None, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.report(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["n_items"], got[1]["contaminated"]) == (15, 13, 1, True)
    assert (got[2]["n_hit"], got[2]["contaminated"]) == (2, True)
    assert (got[3]["n_hit"], got[3]["contaminated"]) == (0, False)
    assert (got[4]["n_words"], got[4]["contaminated"]) == (0, False)
    assert got[None]["n_hit"] == 14


def test_one_word_in_twenty_is_the_limit(spark, bench):
    text = lambda n: "quick brown " + " ".join(f"w{i}" for i in range(n))
    docs = spark.createDataFrame([(1, text(38)), (2, text(39))], "doc_id long, text string")
    assert [r["contaminated"] for r in decontam.report(docs, bench).orderBy("doc_id").collect()] == [True, False]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [2]


def test_spans_are_cut_and_the_rest_stays(spark, bench):
    docs = spark.createDataFrame([(1, "(The Quick, brown fox!", "k"), (2, None, "k")], "doc_id long, text string, n_hit string")
    got = decontam.decontaminate(docs, bench, mode="spans")
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "(The fox!", 2: None}
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, bench, mode="other")


def test_columns_of_any_name_and_the_way_without_broadcast(spark, bench):
    rows = [(1, "the quick brown fox", "k"), (2, "quick fox", "k"), (2, "quick fox", "k"), (None, None, "k"), (3, "a b c d e f g h i j k l m n", "k")]
    for name in ("hit_id", "fp", "a.b"):
        docs = spark.createDataFrame(rows, "doc_id long, text string, x string").withColumnRenamed("x", name)
        for mode, want in (("documents", [(2, "quick fox", "k"), (2, "quick fox", "k"), (None, None, "k")]), ("spans", [(1, "the fox", "k"), (2, "quick fox", "k"), (2, "quick fox", "k"), (None, None, "k"), (3, "", "k")])):
            got = decontam.decontaminate(docs, bench, mode=mode)
            assert got.columns == docs.columns
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), (name, mode)
    ways = [sorted(map(str, decontam.report(docs, bench, broadcast_windows=n).collect())) for n in (0, 10)]
    assert ways[0] == ways[1]


def test_windows_of_a_very_long_text(spark, bench):
    docs = spark.createDataFrame([(1, "x y z " * 300_000 + "quick brown")], "doc_id long, text string")
    r = decontam.report(docs, bench).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (900_002, 2, False)


POLISH = "W tym domu jest pies i kot, a na stole leży książka, którą czyta się wieczorem przy oknie. "


def test_every_label_has_a_reference(spark):
    prose = "the cat and the dog of this house are in a garden with that man who was on the hill by it for an hour "
    rows = [(i, prose + f"number {i} has been at the sea", "en") for i in range(20)] + [(50, POLISH * 4 + "Nie ma go.", "pl")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[50]["word_distance"] < 0.5 and got[50]["char_distance"] < 0.1
    assert got[1]["word_distance"] < 0.6


def test_learned_words_equal_their_sql(spark, tmp_path):
    rows = [(i, " ".join(f"{w}{'' if (i + k) % 3 else i}" for k, w in enumerate((POLISH * 3).split())) + (" the and of" if i % 2 else ""), ("pl", "en", None, "cs")[i % 4]) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.coalesce(1).toPandas().to_parquet(tmp_path / "documents.parquet")
    got, want = quality.quality(df).toPandas(), sql(str(tmp_path), quality.oracle())
    cols = sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_edge_rows_and_empty_tables(spark, odd, empty, bench):
    assert decontam.report(odd, bench).count() == odd.count()
    assert decontam.report(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.report(empty, bench).count() == 0
    kept = decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns
    assert quality.quality(odd).count() == odd.count()
    assert quality.quality(empty).count() == 0
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(empty).count() == 0


def test_repeated_windows_and_lines(spark):
    rows = [(1, "a b c d e a b c d e", "en"), (2, "a a a a a a", "en"), (3, "a b c d e f", "en"), (4, "x\ny\nx\n \n \nx", "en"), (5, "a b c d", "en")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["n_repeat_words"] for i in (1, 2, 3, 5)] == [10, 6, 0, 0]
    assert got[4]["n_dup_lines"] == 2
    assert got[1]["base_failed"] and not got[1]["kept"]


def test_far_histograms_are_rejected_and_short_texts_are_not(spark):
    prose = "the cat and the dog of this house are in a garden with that man who was on the hill by it for an hour "
    rows = [(i, prose * 1 + f"number {i} has been at the sea", "en") for i in range(30)] + [(100, " ".join(f"#$%{i}&*" for i in range(100)), "en"), (101, "#$% " * 3 + "a b c d e f g h", "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] and not got[100] and got[101]


def test_licence_sequences_follow_their_order(spark):
    mit = [licenses.SENTENCES[k] for k in ("mit-grant", "mit-condition", "mit-asis")]
    bsd = [licenses.SENTENCES[k] for k in ("bsd-may", "bsd-source", "bsd-binary", "bsd-endorse")]
    rows = [(1, ". ".join(mit)), (2, ". ".join(reversed(mit))), (3, "\n".join(bsd)), (4, "\n".join(bsd[:3])), (5, "Intro.\nLicensed under CC BY-NC 4.0."), (6, "MIT"), (7, "x.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: (r["licences"], r["use"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        1: (["MIT"], "permissive"), 2: ([], "none"), 3: (["BSD-3-Clause"], "permissive"), 4: (["BSD-2-Clause"], "permissive"),
        5: (["CC-BY-NC-4.0"], "restricted"), 6: ([], "none"), 7: (["CC-BY-NC-4.0", "MIT"], "restricted"),
    }


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_wrapped_and_commented_licences(spark):
    whole = {"MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + ENDORSE, "GPL-3.0-or-later": GPL, "Apache-2.0": APACHE}
    rows, want = [], []
    for name, text in whole.items():
        for width in (40, 72, 80, 1000):
            for sign in ("", "// ", "# ", " * ", "dnl ", "\t;; "):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part.strip(), width), ""]]
                rows.append((len(rows), "\n".join(sign + x for x in lines)))
                want.append([name])
    got = {r["doc_id"]: r["licences"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This file is released under the MIT License.", ["MIT"]),
        ("x\n\nThe MIT License (MIT)\n\nCopyright 2020 A B", ["MIT"]),
        ("MIT License\n", ["MIT"]),
        ("This source code is licensed under\n the terms of the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("The code is available under the 3-Clause BSD License", ["BSD-3-Clause"]),
        ("All texts are published under CC BY-NC 4.0.\nThis work is licensed\nunder the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
        ("# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy", ["MPL-2.0"]),
        ("We talked about the MIT License and went home.", []),
        ("An end\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Permission | is hereby granted", []),
        ("All\n\nrights reserved", []),
    ],
)
def test_titles_and_notices_in_other_words(spark, text, want):
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licences"] == want


def test_native_operators_run_no_python(spark, sf, capsys):
    for name in ("op2_quality_rules", "op6_license_scans", "op9_benchmark_decontamination"):
        registry.queries()[name](spark, sf).explain()
        plan = capsys.readouterr().out
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_window_hashes_tell_windows_apart(spark):
    rows = [(i, [hash((i * j) % 3) for j in range(i)]) for i in range(1, 24)]
    df = spark.createDataFrame(rows, "k int, h array<long>")
    for n in (1, 2, 3, 5, 8, 13, 17):
        seen = {}
        for r in df.where(F.size("h") >= n).select("h", window_hashes(F.col("h"), n).alias("w")).collect():
            assert len(r["w"]) == len(r["h"]) - n + 1
            for i, x in enumerate(r["w"]):
                assert seen.setdefault(tuple(r["h"][i : i + n]), x) == x
        assert len(set(seen.values())) == len(seen)


def test_words_are_counted_as_they_are_split(spark):
    texts = [None, "", " ", "a", "\u00e9\U0001F600a b\x80x\x7fy", "  A9z\n\u00ffZ@[`{", "\x00a\x2f0\x3a9", "don't stop-now 3.14"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.where(decontam.n_words(F.col("text")) != F.size(decontam.item_words(F.col("text")))).count() == 0


def test_repeats_equal_a_plain_count(spark):
    r = random.Random(3)
    texts = [" ".join(r.choices("ab", k=n)) for n in range(40)] + [" ".join(map(str, range(30))), "a b c d e f a b c d e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.repeated_words(words(F.col("text"))).alias("n"))
    for row in df.collect():
        ws = row["text"].split()
        grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
        hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        assert row["n"] == len(hit), row["text"]
