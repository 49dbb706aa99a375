"""Benchmark decontamination: a broadcast set of test n-gram hashes, scanned windows, verified hits. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, ascii_lower, fresh, let, own, quoted, window_hashes, written

WINDOW = 13
#: A document is contaminated from one hit word in so many.
RATIO = 20
#: Windows of the benchmark up to which their hashes, and nothing else, are broadcast (24 bytes each in a hash table); beyond, Spark shuffles instead.
BROADCAST_WINDOWS = 2_000_000
#: Documents with hits up to which they are broadcast (24 bytes each) to the scan that removes them.
BROADCAST_HITS = 500_000
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text that isn't lower-cased yet.
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def item_words(c: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), _BREAK), lambda w: w != "")


def _word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(n, h, gram, items): the distinct windows of all items; an item of fewer words, but not none, is one window."""
    ws = benchmark.select(F.col("item_id").cast("string").alias("item"), F.explode(F.array(item_words(F.col("text")))).alias("ws")).where(F.size("ws") > 0)
    ws = ws.withColumn("n", F.least(F.size("ws"), F.lit(window)))
    grams = ws.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("n") + 1), lambda i: F.slice("ws", i, F.col("n")))).alias("gram"))
    of = lambda n: let(_word_hashes(F.col("gram")), lambda x: window_hashes(x, n))[0]
    h = F.coalesce(*[F.when(F.col("n") == n, of(n)) for n in range(1, window + 1)])
    return grams.groupBy("n", "gram").agg(F.collect_set("item").alias("items")).select("n", h.alias("h"), "gram", "items")


def _covered(spans: Column) -> Column:
    """How many positions a sorted array of (pos, n) covers."""
    zero = F.lit(0).cast("long")

    def step(a: Column, s: Column) -> Column:
        end = (s["pos"] + s["n"]).cast("long")
        return F.struct((a["c"] + F.greatest(zero, end - F.greatest(a["e"], s["pos"].cast("long")))).alias("c"), F.greatest(a["e"], end).alias("e"))

    return F.aggregate(spans, F.struct(zero.alias("c"), zero.alias("e")), step, lambda a: a["c"])


def find_hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, fp, spans, items, n_hit) of the documents in which windows of the benchmark occur.

    spans: sorted (pos, n) in words, n_hit: words inside any of them, items: sorted ids as text. fp, a hash of
    the text, keeps different texts under one id apart; equal rows give one row. The document's side is one
    scan and a hash probe, and only windows whose hash is found are shuffled, to be verified on the words. Beyond
    `broadcast_windows` each window is shuffled with its own words alone. A text is taken whole, its words in one array.
    An empty benchmark gives no rows.
    """
    grams = written(benchmark_windows(benchmark, window))
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most `window` values
    few = grams.count() <= broadcast_windows
    ws = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(F.col(quoted(text))).alias("fp"), F.explode(F.array(item_words(F.col(quoted(text))))).alias("ws"))
    ws = ws.where(F.size("ws") >= (lengths[0] if lengths else 0))
    each = lambda h: F.array(*[F.struct(F.lit(n).alias("n"), F.when(F.size(h) >= n, window_hashes(h, n)).alias("hs")) for n in lengths])
    wins = let(_word_hashes(F.col("ws")), each) if lengths else F.array().cast("array<struct<n:int,hs:array<bigint>>>")
    probe = ws.select("doc_id", "fp", "ws", F.explode(wins).alias("w")).select("doc_id", "fp", "ws", F.col("w.n").alias("n"), F.posexplode("w.hs").alias("pos", "h"))
    if few:
        probe = probe.join(F.broadcast(grams.select("h").distinct()), "h", "left_semi")
    probe = probe.select("doc_id", "fp", "pos", "n", "h", F.slice("ws", F.col("pos") + 1, F.col("n")).alias("ws"))
    # array_position and not an equality, which the planner would make part of the join's key
    found = probe.join(grams.drop("n"), "h").where(F.array_position(F.array("gram"), F.col("ws")) > 0)
    per = found.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.withColumn("n_hit", _covered(F.col("spans")))


def contaminated(n_hit: Column, n_words: Column, ratio: int = RATIO) -> Column:
    return (n_hit > 0) & (ratio * n_hit >= n_words)


def n_words(text: Column) -> Column:
    # as a class of what words hold; one of all but the separators takes Java's matcher ten times as long
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or wordless texts have no words and no hits; an empty benchmark gives none either. Repeated rows
    are reported one by one; a null id is a value of its own.
    """
    small = docs.select("doc_id", F.xxhash64("text").alias("_fp"), n_words(F.col("text")).alias("n_words"))
    f = find_hits(docs, benchmark, **kw).withColumnRenamed("doc_id", "_id")
    out = small.join(f, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_fp") == F.col("fp")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), contaminated(n_hit, F.col("n_words")).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """docs without contaminated documents (mode "documents"), or with hit words cut from their texts (mode "spans").

    "documents" drops a document when at least one word in `ratio` is hit; all other rows and columns stay, whatever
    their names. "spans" keeps each row and removes each hit word with the separators after it. Null, empty and wordless
    texts stay as they are; an empty benchmark changes nothing. Repeated rows fare alike. An item as long as the limit
    counts as contamination (a tie drops).
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = written(find_hits(docs, benchmark, doc_id=doc_id, text=text, window=window))
    key, fp, spans, hit = fresh(docs, "hit_id", "hit_fp", "hit_spans", "n_hit_words")
    f = found.select(F.col("doc_id").alias(key), F.col("fp").alias(fp), F.col("n_hit").alias(hit), *([F.col("spans").alias(spans)] if mode == "spans" else []))
    body = F.col(quoted(text))
    joined = docs.join(F.broadcast(f) if mode == "documents" and found.count() <= BROADCAST_HITS else f, F.col(quoted(doc_id)).eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(fp)), "left")
    if mode == "documents":
        bad = contaminated(F.coalesce(hit, F.lit(0).cast("long")), n_words(body), ratio)
        return joined.where(F.col(hit).isNull() | ~bad).select(*own(docs))
    piece = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    lead = F.regexp_extract(body, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    keep = let(F.col(spans), lambda found: F.filter(F.regexp_extract_all(body, F.lit(piece), F.lit(0)), lambda w, i: ~F.exists(found, lambda s: (i >= s["pos"]) & (i < s["pos"] + s["n"]))))
    cut = F.when(F.col(spans).isNull(), body).otherwise(F.concat(lead, F.concat_ws("", keep)))
    return joined.select(*[cut.alias(c) if c == text else F.col(quoted(c)) for c in docs.columns])


def oracle() -> str:
    ws = lambda t: f"list_filter(string_split_regex(translate(coalesce({t}, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
    WITH b AS (SELECT item_id, {ws('text')} AS ws FROM benchmark),
    g AS (SELECT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram
          FROM (SELECT *, least(len(ws), {WINDOW}) AS n FROM b WHERE len(ws) > 0)),
    lens AS (SELECT DISTINCT n FROM g),
    d AS (SELECT doc_id, text, {ws('text')} AS ws FROM documents),
    p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, lens WHERE len(ws) >= n),
    h AS (SELECT DISTINCT doc_id, i, p.n, item_id FROM p JOIN g ON p.n = g.n AND array_to_string(ws[i:i + p.n - 1], ' ') = gram),
    c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
    s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND {RATIO} * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""
