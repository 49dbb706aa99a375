"""Quality rules: divergence of a document's histograms from language references. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, let, quoted, window_hashes, words, written

# Frequent function words of four languages. Those of other labels are learned.
COMMON_WORDS = {
    "de": ("als", "am", "an", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es", "für", "hat", "im", "in", "ist", "mit", "nicht", "sich", "sie", "und", "von", "wie", "zu"),
    "en": ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "he", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "will", "with", "you"),
    "es": ("a", "al", "como", "con", "de", "del", "el", "en", "es", "esta", "la", "las", "lo", "los", "más", "no", "o", "para", "pero", "por", "que", "se", "ser", "sin", "son", "su", "un", "una", "y", "ya"),
    "fr": ("au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ne", "ou", "par", "pas", "plus", "pour", "que", "qui", "se", "son", "sur", "un", "une", "à"),
}
#: Character classes as regex sets; what is in none of them is the class "other".
CLASSES = (r"a-z", r"\x20\x09-\x0D", r"\x{80}-\x{10FFFF}", r"A-Z", r".,;:!?'\x22()-", r"0-9")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Below these a histogram says too little, and its distance isn't judged.
MIN_CHARS, MIN_JUDGED_WORDS = 200, 50
#: Largest Jensen-Shannon distances (0 to 1) from the nearest reference that are kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.85
#: Words that are learned for a label without a list, its most frequent ones, and their most characters.
LEARNED, LEARNED_CHARS = 30, 12
_TRIM = ".,;:!?"


def common_words(docs: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """The common words of each label: COMMON_WORDS, and of any other label the most frequent words of all its documents (equal ones by the word).

    What comes to the driver is LEARNED words for each such label.
    """
    other = docs.where(F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS)))
    ws = other.select("lang", F.explode(words(F.col(quoted(text)))).alias("w")).select("lang", ascii_lower(F.rtrim(F.col("w"), F.lit(_TRIM))).alias("w"))
    n = ws.where((F.length("w") <= LEARNED_CHARS) & F.col("w").rlike(r"\p{L}")).groupBy("lang", "w").count()
    ranked = n.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w"))).where(F.col("r") <= LEARNED)
    out = {k: list(v) for k, v in COMMON_WORDS.items()}
    for r in ranked.select("lang", "w").collect():
        out.setdefault(r["lang"], []).append(r["w"])
    return out


def _listed(lists: dict[str, list[str]]) -> list[str]:
    return sorted({w for ws in lists.values() for w in ws})


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that occur twice or more.

    Distinct hashes prove distinct windows, and then nothing is repeated; else the windows that share a hash
    are sorted themselves and neighbours compared.
    """
    zero = F.lit(0).cast("long")

    def twice(made: Column, key: str) -> Column:
        """Of structs, those that share their key with another."""
        return let(F.array_sort(made), lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)[key] == x[key]) | (F.get(s, k + 1)[key] == x[key])))

    def exact(w: Column, h: Column) -> Column:
        alike = twice(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), "h")
        grams = twice(F.transform(alike, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["i"] + 1, window)).alias("g"), x["i"].alias("i"))), "g")
        start = F.struct(zero.alias("c"), zero.alias("e"))
        step = lambda a, i: F.struct((a["c"] + i + window - F.greatest(a["e"], i.cast("long"))).alias("c"), (i + window).cast("long").alias("e"))
        return F.aggregate(F.array_sort(F.transform(grams, lambda x: x["i"])), start, step, lambda a: a["c"])

    def hashed(w: Column) -> Column:
        hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: window_hashes(h, window))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(exact(w, h)))

    return let(ws, lambda w: F.when(F.size(w) <= window, zero).otherwise(hashed(w)))


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _class_counts(text: Column) -> Column:
    """Characters of each class, then of none, then those of them that are symbols. Each class is cut from what the ones before it left, the commonest first."""

    def cut(rest: Column, todo: tuple[str, ...], counts: list[Column]) -> Column:
        if not todo:
            return F.array(*counts, F.length(rest).cast("long"), (F.length(rest) - F.length(F.translate(rest, SYMBOLS, ""))).cast("long"))
        return let(F.regexp_replace(rest, f"[{todo[0]}]+", ""), lambda less: cut(less, todo[1:], [*counts, (F.length(rest) - F.length(less)).cast("long")]))

    return let(text, lambda t: cut(t, CLASSES, []))


def features(docs: DataFrame, listed: list[str], text: str = "text") -> DataFrame:
    """The base counts of each document, its character-class counts and its common words (w: number in `listed`, n), beside doc_id and lang."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    out = docs.select("doc_id", "lang", F.explode(F.array(F.struct(t.alias("t"), words(t).alias("ws")))).alias("x")).select("doc_id", "lang", F.col("x.t").alias("t"), F.col("x.ws").alias("ws"))
    t, ws = F.col("t"), F.col("ws")
    short = F.filter(F.transform(ws, lambda w: F.rtrim(w, F.lit(_TRIM))), lambda w: F.length(w) <= max(map(len, listed)))
    out = out.select(
        "doc_id",
        "lang",
        F.size(ws).cast("long").alias("n_words"),
        F.length(t).cast("long").alias("n_chars"),
        repeated_lines(t).alias("n_dup_lines"),
        repeated_words(ws).alias("n_repeat_words"),
        _class_counts(t).alias("classes"),
        F.filter(F.transform(short, lambda w: ascii_lower(w)), lambda w: w.isin(listed)).alias("common"),
    )
    number = F.array(*[F.lit(w) for w in listed])
    runs = let(F.col("common"), lambda c: F.transform(F.array_distinct(c), lambda w: F.struct((F.array_position(number, w) - 1).cast("int").alias("w"), F.size(F.filter(c, lambda x: x == w)).alias("n"))))
    n = len(CLASSES) + 1
    return out.withColumns({"word_chars": F.col("n_chars") - F.col("classes")[1], "n_symbols": F.col("classes")[n], "classes": F.slice("classes", 1, n), "n_common": F.size("common").cast("long"), "common": runs})


def references(feats: DataFrame) -> dict[str, tuple[list[float], dict[int, float]]]:
    """Of each label whose documents hold common words: its character-class shares, and its common words' shares of all common words.

    Summed over all labelled documents; what comes to the driver is one number for each label and class or word.
    """
    known = feats.where(F.col("lang").isNotNull())
    chars = known.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]).collect()
    own: dict[str, dict[int, int]] = {}
    for r in known.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.w").agg(F.sum("x.n").alias("n")).collect():
        own.setdefault(r["lang"], {})[r["w"]] = r["n"]
    return {r["lang"]: ([x / sum(r[1:]) for x in r[1:]], {w: n / sum(own[r["lang"]].values()) for w, n in sorted(own[r["lang"]].items())}) for r in chars if own.get(r["lang"])}


def _term(p: Column, q: Column) -> Column:
    """Both halves of one bin's share of the Jensen-Shannon divergence in bits."""
    half = lambda a: F.when(a > 0, a / 2 * F.log2(2 * a / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))


def _word_divergence(own: Column) -> Column:
    """Of the document's common words from a reference; bins that the document lacks add half their reference share."""

    def add(a: Column, x: Column) -> Column:
        p, q = x["n"] / F.col("n_common"), F.coalesce(F.element_at(own, x["w"]), F.lit(0.0))
        return F.struct((a["d"] + _term(p, q)).alias("d"), (a["q"] + q).alias("q"))

    return F.aggregate(F.col("common"), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), add, lambda a: a["d"] + (1 - a["q"]) / 2)


def judge(feats: DataFrame, refs: dict[str, tuple[list[float], dict[int, float]]]) -> DataFrame:
    """feats with char_distance, word_distance (to the nearest reference; null without one), base_failed and kept."""
    order = [refs[k] for k in sorted(refs)] or [([0.0] * (len(CLASSES) + 1), {0: 0.0})]
    by_class = F.array(*[F.array(*map(F.lit, shares)) for shares, _ in order])
    by_word = F.array(*[F.create_map(*[F.lit(x) for kv in own.items() for x in kv]) for _, own in order])
    far = lambda p, q: _distance(F.aggregate(F.zip_with(p, q, _term), F.lit(0.0), lambda s, x: s + x))
    nearest = let(F.transform("classes", lambda c: c / F.col("n_chars")), lambda p: F.array_min(F.transform(by_class, lambda q: far(p, q))))
    nearest_words = F.array_min(F.transform(by_word, lambda own: _distance(_word_divergence(own))))
    some = F.lit(bool(refs))
    out = feats.withColumns(
        {
            "char_distance": F.when(some & (F.col("n_chars") > 0), nearest),
            "word_distance": F.when(some & (F.col("n_common") > 0), nearest_words).when(some, 1.0),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    far_chars = (F.col("n_chars") >= MIN_CHARS) & (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE)
    far_words = (F.col("n_words") >= MIN_JUDGED_WORDS) & (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far_chars & ~far_words)


def quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs (doc_id, text, lang), with the base counts, the distances and the verdict.

    Each label, whatever it is, has a reference from its own documents, and a document is kept or not by the nearest one,
    so that documents without a label are judged, too. A null text is an empty one, which fails the base rule. With no
    reference at all (an empty table) only the base rule judges. Repeated rows count in the references as
    often as they occur. A text is taken whole, its words in one array, however long. Distances equal to a limit are
    kept. Other columns of docs are not read.
    """
    lists = common_words(docs, text)
    feats = written(features(docs, _listed(lists), text))
    return judge(feats, references(feats))


def oracle() -> str:
    listed = ", ".join(f"('{w}')" for w in _listed({k: list(v) for k, v in COMMON_WORDS.items()}))
    langs = ", ".join(f"'{k}'" for k in COMMON_WORDS)
    counts = ", ".join(f"length(t) - length(regexp_replace(t, '[{c.replace("'", "''")}]+', '', 'g'))" for c in CLASSES)
    n = len(CLASSES) + 1
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} / 2 * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"""
    WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
    f AS (SELECT doc_id, lang, len(ws) AS n_words, length(t) AS n_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, [{counts}] AS k FROM d),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)),
    tw AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    rep AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS x FROM tw) GROUP BY doc_id),
    w AS (SELECT doc_id, lang, regexp_replace(translate(unnest(ws), '{UPPER}', '{LOWER}'), '[{_TRIM}]+$', '') AS w FROM d),
    learned AS (SELECT w FROM w WHERE lang IS NOT NULL AND lang NOT IN ({langs}) AND length(w) <= {LEARNED_CHARS} AND regexp_matches(w, '\\p{{L}}')
                GROUP BY lang, w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, w) <= {LEARNED}),
    listed AS (FROM (VALUES {listed}) v(w) UNION FROM learned),
    cw AS (SELECT doc_id, lang, w, count(*) AS n FROM w WHERE w IN (FROM listed) GROUP BY ALL),
    nc AS (SELECT doc_id, sum(n) AS n_common FROM cw GROUP BY doc_id),
    fk AS (SELECT * REPLACE (list_append(k, n_chars - list_sum(k)) AS k) FROM f),
    c AS (SELECT doc_id, lang, n_chars, unnest(range(1, {n + 1})) AS j, unnest(k) AS v FROM fk),
    rc AS (SELECT lang, j, sum(v) / sum(sum(v)) OVER (PARTITION BY lang) AS q FROM c WHERE lang IS NOT NULL GROUP BY lang, j),
    rw AS (SELECT lang, w, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cw WHERE lang IS NOT NULL GROUP BY lang, w),
    ref AS (SELECT DISTINCT lang FROM rw),
    dc AS (SELECT doc_id, min(sqrt(greatest(0.0, least(1.0, s)))) AS char_distance FROM (
            SELECT doc_id, rc.lang, sum({half('(v / n_chars)', 'q')} + {half('q', '(v / n_chars)')}) AS s FROM c JOIN rc USING (j) JOIN ref ON ref.lang = rc.lang WHERE n_chars > 0 GROUP BY ALL) GROUP BY doc_id),
    dw AS (SELECT doc_id, min(sqrt(greatest(0.0, least(1.0, s)))) AS word_distance FROM (
            SELECT cw.doc_id, ref.lang, sum({half('(n / n_common)', 'coalesce(q, 0)')} + {half('coalesce(q, 0)', '(n / n_common)')}) + (1 - sum(coalesce(q, 0))) / 2 AS s
            FROM cw JOIN nc USING (doc_id) CROSS JOIN ref LEFT JOIN rw ON rw.lang = ref.lang AND rw.w = cw.w GROUP BY ALL) GROUP BY doc_id),
    a AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - k[2] AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_chars, char_distance,
            CASE WHEN word_distance IS NULL AND EXISTS (FROM ref) THEN 1.0 ELSE word_distance END AS word_distance
          FROM fk LEFT JOIN rep USING (doc_id) LEFT JOIN dc USING (doc_id) LEFT JOIN dw USING (doc_id)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (n_chars >= {MIN_CHARS} AND coalesce(char_distance, 0) > {MAX_CHAR_DISTANCE})
             AND NOT (n_words >= {MIN_JUDGED_WORDS} AND coalesce(word_distance, 0) > {MAX_WORD_DISTANCE}) AS kept
    FROM b"""
