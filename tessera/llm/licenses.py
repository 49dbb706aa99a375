"""Licence scan: normalised sentences become known identifiers, whose sequences meet ordered rules. Native functions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, let

# Identifiers and sentences, normalised (letters and digits, single spaces, lower case).
SENTENCES = {
    "apache2-notice": "licensed under the apache license version 2 0",
    "apache2-notice-long": "licensed under the apache license version 2 0 the license",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-spdx": "spdx license identifier apache 2 0",
    "mit-notice": "released under the mit license",
    "mit-notice-work": "this work is licensed under the mit license",
    "mit-notice-project": "this project is licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-spdx": "spdx license identifier mit",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-bare": "licensed under the gnu general public license version 3",
    "gpl3-spdx": "spdx license identifier gpl 3 0 only",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-may": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd3-notice": "licensed under the bsd 3 clause license",
    "ccbync4-notice": "licensed under cc by nc 4 0",
    "ccby4-notice": "licensed under cc by 4 0",
    "ccbysa4-notice": "licensed under cc by sa 4 0",
    "ccby4-notice-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0-notice": "this work is dedicated to the public domain under cc0 1 0",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all-rights-reserved": "all rights reserved",
}
# Licence and the sentences that must follow one another in this order (others may stand between); an earlier rule hides the later ones named with it.
RULES = (
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-notice-long", "apache2-comply")),
    ("Apache-2.0", ("apache2-comply", "apache2-copy", "apache2-asis")),
    ("Apache-2.0", ("apache2-spdx",)),
    ("BSD-3-Clause", ("bsd-may", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd3-notice",)),
    ("BSD-2-Clause", ("bsd-may", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("ccby4-notice",)),
    ("CC-BY-4.0", ("ccby4-notice-long",)),
    ("CC-BY-NC-4.0", ("ccbync4-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-only", ("gpl3-notice-bare",)),
    ("GPL-3.0-only", ("gpl3-spdx",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-work",)),
    ("MIT", ("mit-notice-project",)),
    ("MIT", ("mit-spdx",)),
    ("MIT", ("mit-grant", "mit-condition", "mit-asis")),
    ("MPL-2.0", ("mpl2-notice",)),
    ("proprietary", ("all-rights-reserved",)),
)
#: A licence found by its longer rule hides the one whose rule is a part of it.
HIDES = {"BSD-2-Clause": "BSD-3-Clause"}
#: Licences that allow use in a training corpus.
PERMISSIVE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "MIT")
#: Where a sentence ends: a line's end, or a stop before white space or the text's end.
_END = r"\n|[.;:]+([\x20\x09-\x0D]+|$)"
_GAP = "[^a-z0-9]+"
# Titles that stand for a licence, and the names that notices in other words give it, as what they are reported.
TITLES = {
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "mit license mit": "mit-title",
    "apache license version 2 0": "apache2-title",
    "apache license version 2 0 january 2004": "apache2-title",
    "bsd 2 clause license": "bsd2-title",
    "the bsd 2 clause license": "bsd2-title",
    "bsd 3 clause license": "bsd3-title",
    "the bsd 3 clause license": "bsd3-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "mozilla public license version 2 0": "mpl2-title",
}
NAMES = {
    "apache license version 2 0": "apache2-notice",
    "apache license 2 0": "apache2-notice",
    "apache 2 0 license": "apache2-notice",
    "mit license": "mit-notice",
    "gnu general public license version 3": "gpl3-notice-bare",
    "bsd 3 clause license": "bsd3-notice",
    "3 clause bsd license": "bsd3-notice",
    "cc by nc 4 0": "ccbync4-notice",
    "cc by 4 0": "ccby4-notice",
    "cc by sa 4 0": "ccbysa4-notice",
    "creative commons attribution 4 0 international license": "ccby4-notice-long",
    "mozilla public license version 2 0": "mpl2-notice",
    "mozilla public license v 2 0": "mpl2-notice",
}
TITLE_RULES = (
    ("Apache-2.0", ("apache2-title",)),
    ("BSD-2-Clause", ("bsd2-title",)),
    ("BSD-3-Clause", ("bsd3-title",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("MIT", ("mit-title",)),
    ("MPL-2.0", ("mpl2-title",)),
)
#: How a notice in other words leads to the name: `[this ... is] licensed under [the terms of] [the]`.
_LEAD = "(?:(?:(?:this|the|our|all) )?(?:(?!(?:this|the|our|all) )[a-z0-9]+ ){1,3}(?:is|are) )?(?:(?:re)?licensed|released|distributed|published|provided|available|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
#: Between two words of a sentence: at most one line's end or stop, and a comment sign that is a word.
_BREAK = r"(?: \|)?(?: (?:dnl|rem))? "


def _any(sentences: Iterable[str], between: str = " ") -> str:
    return "|".join(x.replace(" ", between) for x in sorted(sentences, key=lambda x: (-len(x), x)))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES, titles: dict[str, str] = TITLES, names: dict[str, str] = NAMES) -> Column:
    """The identifiers of the known sentences of a text, in order: sentences, titles and notices that start and end as a line or a sentence does.

    Line ends and stops within them count as blanks, so wrapped and commented texts match. What matches without one goes first.
    """
    known = titles | {v: k for k, v in sentences.items()}
    ways = [_any(known), _any(known, _BREAK), _LEAD.replace(" ", _BREAK) + f"(?:{_any(names, _BREAK)})(?:{_BREAK}license)?"]
    found = r"\|(?: (?:dnl|rem))? (?:" + "|".join(f"(?:{w})(?= \\|)" for w in ways) + ")"
    line = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "|" + UPPER, " " + LOWER), r"\n[\x20\x09]*;+[\x20\x09]*|" + _END, " | ")
    line = F.concat(F.lit("| "), F.trim(F.regexp_replace(line, "[^a-z0-9|]+", " ")), F.lit(" |"))
    plain = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\|( (dnl|rem)(?= ))?", " "), " +", " "))
    ids, other = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (known, names))
    name = lambda s: F.regexp_replace(F.regexp_replace(s, f"^{_LEAD}", ""), f"^({_any(names)}) license$", "$1")
    return F.transform(F.transform(F.regexp_extract_all(line, F.lit(found), 0), plain), lambda s: F.coalesce(F.try_element_at(ids, s), F.try_element_at(other, s), F.try_element_at(other, name(s))))


def _pattern(seq: tuple[str, ...]) -> str:
    """LIKE pattern of sequences `<a><b>...` that hold seq in this order, others between them allowed."""
    return "%" + "".join(f"<{x}>%" for x in seq)


def licences_of(ids: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES + TITLE_RULES, hides: dict[str, str] = HIDES) -> Column:
    """The sorted distinct licences whose rules the identifier sequence meets."""

    def found(line: Column) -> Column:
        hit = {}
        for name, seq in rules:
            hit[name] = hit.get(name, F.lit(False)) | line.like(_pattern(seq))
        return F.array(*[F.when(hit[n] & ~hit[hides[n]] if n in hides else hit[n], n) for n in sorted(hit)])

    line = F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    return F.array_compact(let(line, found))


def scan(df: DataFrame, text: str = "text", *, sentences: dict[str, str] = SENTENCES, rules=RULES + TITLE_RULES, hides=HIDES, permissive=PERMISSIVE) -> DataFrame:
    """df with sentence_ids and licences (arrays) and use: none, permissive (every licence found is) or restricted.

    Null and empty texts have no sentences and no licences. A sentence counts wherever it stands in the
    text and as often as it does. Repeated rows are scanned one by one. Columns of df with these names are
    replaced; all others stay.
    """
    out = df.withColumn("sentence_ids", sentence_ids(F.col(text), sentences)).withColumn("licences", licences_of(F.col("sentence_ids"), rules, hides))
    free = F.forall("licences", lambda x: x.isin(list(permissive)))
    return out.withColumn("use", F.when(F.size("licences") == 0, "none").when(free, "permissive").otherwise("restricted"))


def oracle() -> str:
    known = ", ".join(f"('{v}', '{k}')" for k, v in SENTENCES.items())
    names = sorted({n for n, _ in RULES})
    hit = {n: "(" + " OR ".join(f"line LIKE '{_pattern(q)}'" for m, q in RULES if m == n) + ")" for n in names}
    arms = ", ".join(f"CASE WHEN {hit[n]}{f' AND NOT {hit[HIDES[n]]}' if n in HIDES else ''} THEN '{n}' END" for n in names)
    free = ", ".join(f"'{x}'" for x in PERMISSIVE)
    return rf"""
    WITH s AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '{_END}')) AS s, generate_subscripts(string_split_regex(coalesce(text, ''), '{_END}'), 1) AS i FROM documents),
    known(norm, id) AS (VALUES {known}),
    k AS (SELECT doc_id, i, id FROM s JOIN known ON norm = trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '{_GAP}', ' ', 'g'))),
    q AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids, string_agg('<' || id || '>', '' ORDER BY i) AS line FROM k GROUP BY doc_id),
    f AS (SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, list_filter([{arms}], lambda x: x IS NOT NULL) AS l FROM (SELECT d.doc_id, n, ids, coalesce(line, '') AS line FROM documents d LEFT JOIN q USING (doc_id)))
    SELECT doc_id, n_sentences, sentence_ids, array_to_string(l, ',') AS licences,
           CASE WHEN len(l) = 0 THEN 'none' WHEN len(list_filter(l, lambda x: x NOT IN ({free}))) = 0 THEN 'permissive' ELSE 'restricted' END AS use
    FROM f"""
