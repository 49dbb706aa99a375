"""MinHash near-duplicates: bottom-k sketches of one hash function, overlaps from inverted lists, union-sketch filter, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, bounded_batches, discard, fresh, own, quoted, written

SHINGLE = 5
#: Similar from PERCENT * union <= 100 * intersection on.
PERCENT = 75
#: Values of a sketch.
SKETCH = 24
#: Least similarity that the union's sketch must estimate: five of its 24 values. At similarity 0.75 it is less with a chance of 3.3e-9.
MIN_ESTIMATE = 5 / 24 - 1e-9
#: Documents of an inverted list up to which its pairs are formed at once; longer lists go through leaders first.
LIGHT = 16
#: Rows up to which a table of one to three numbers is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Most rounds of leaders for long lists before the exact way, and the pairs for each document that it takes on without another round.
ROUNDS, FEW_PAIRS = 4, 800
#: Edges that a task joins before it passes their components on.
FOREST_EDGES = 1_000_000

_PRIMES = tuple(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SHINGLE))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, n: int = SHINGLE, hashes: WordHash | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text; of fewer words, one of the whole sequence; of none, none."""
    words = (text or "").encode().lower().split()  # of bytes, both know ASCII only
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map((WordHash() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(_PRIMES[k]) + h[k : len(h) - width + 1 + k])
    return np.unique(acc.view(np.int64))


_SKETCHED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class", pa.string()), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])
#: Rows whose sets are in memory at once.
_ROWS = 256


def _per_slice(schema: pa.Schema, columns) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()  # goes with the task
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                made = columns([shingles(t.as_py(), hashes=hashes) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True)]], schema=schema)

    return run


_sketched = _per_slice(_SKETCHED, lambda sets: ([len(s) for s in sets], [hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets], [s[:SKETCH] for s in sets]))
_whole = _per_slice(_SETS, lambda sets: (sets,))


def sketch(docs: DataFrame) -> DataFrame:
    """(id, n, class, sketch) of documents (id, text): the set's size, a digest of it that equal sets share (null if empty), its smallest hashes."""
    return docs.select("id", "text").mapInArrow(_sketched, "id long, n long, class string, sketch array<long>")


def _alike(a: Column, b: Column) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return PERCENT * F.greatest(a, b) <= 100 * F.least(a, b)


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the sketch of the union: the share of its values that both sketches hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _small(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it holds at most BROADCAST_ROWS."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _full_sets(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """(id, set) of the documents named by the written table ids; only their texts are shuffled if the ids are few enough to be broadcast."""
    named = docs.select("id", "text").join(_small(ids), "id", "left_semi")
    return (named.dropDuplicates(["id", "text"]) if repeated else named).mapInArrow(_whole, "id long, set array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    # no distinct here, which would hold the rows of a leader together that Spark can deal to several tasks
    return full.where(100 * common >= PERCENT * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Of candidate pairs (a, b), those that the union's sketch doesn't rule out and whose full sets are similar.

    Full sets are made only for documents of pairs that pass the sketch.
    """
    side = lambda k: reps.select(F.col("id").alias(k), F.col("sketch").alias(f"s{k}"))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").where(estimate(F.col("sa"), F.col("sb")) >= MIN_ESTIMATE).select("a", "b"))
    needed = written(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = written(_full_sets(docs, needed, repeated))
    out = written(_similar(likely, sets))
    discard(likely, needed, sets)
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to links of each node with the smallest of those that the edges of this task join it with; so many edges at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def flush() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])

    seen = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for node in (x, y):
                parent.setdefault(node, node)
            low, high = sorted((root(x), root(y)))
            parent[high] = low
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield flush()
            parent.clear()
            seen = 0
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes of edges (a, b): the smallest id reachable.

    Each task joins what its own edges join; then each node takes its smallest neighbour, and that one's, for a
    label, and labels that an edge still holds apart are the nodes of a smaller graph, which is solved alike.
    """
    forest = written(edges.mapInArrow(_forest, "a long, b long").distinct())
    both = forest.union(forest.select("b", "a"))
    first = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("near")))
    labels = written(first.join(first.select(F.col("id").alias("near"), F.col("near").alias("label")), "near").select("id", "label"))
    side = lambda k: labels.select(F.col("id").alias(k), F.col("label").alias(f"l{k}"))
    apart = written(forest.join(side("a"), "a").join(side("b"), "b").where("la != lb").select(*_pair(F.col("la"), F.col("lb"))).distinct())
    discard(first, forest)
    if apart.isEmpty():
        discard(apart)
        return labels.select("id", F.col("label").alias("component"))
    above = components(apart).withColumnRenamed("id", "label")
    return written(labels.join(above, "label", "left").select("id", F.coalesce("component", "label").alias("component")))


def _light_pairs(shared: DataFrame) -> DataFrame:
    """Pairs of documents in lists of at most LIGHT, with at least two such values in common (one where a whole set is in the sketch)."""
    lists = shared.where(F.col("df") <= LIGHT).groupBy("v").agg(F.collect_list(F.struct("id", "n")).alias("m"))

    def partners(x: Column) -> Column:
        return F.transform(F.filter("m", lambda y: (y["id"] > x["id"]) & _alike(x["n"], y["n"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.least(x["n"], y["n"]).alias("n")))

    pairs = lists.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c"), F.min("p.n").alias("n"))
    return pairs.where((F.col("c") >= 2) | (F.col("n") <= SKETCH)).select("a", "b")


def _heavy_lists(shared: DataFrame) -> DataFrame:
    """(v, id, n, h): entries of long lists, of documents with more than an eighth of their values (h of them) in such lists.

    Any other document shares two light values (one where the set is in the sketch) with each that is similar to it.
    """
    heavy = shared.where(F.col("df") > LIGHT)
    mostly = heavy.groupBy("id", "k").agg(F.count("*").alias("h")).where(8 * F.col("h") > F.col("k")).select("id", "h")
    return written(heavy.join(mostly, "id").select("v", "id", "n", "h"))


def _labelled(df: DataFrame, comps: DataFrame, k: str) -> DataFrame:
    """df with {k}_in, the component of the node in column k (itself where no link is known)."""
    known = comps.select(F.col("id").alias(k), F.col("component").alias("_c"))
    return df.join(known, k, "left").withColumn(f"{k}_in", F.coalesce("_c", k)).drop("_c")


def ordered_prefixes(sets: DataFrame) -> DataFrame:
    """(v, id, n, j): of each set the values that another set also has among its rarest quarter, j values being rarer.

    All sets are ordered alike, by how many sets hold a value. Similar sets share at least three quarters of either, so
    they share a value of both prefixes. Values of one set come first in any case, and are only counted.
    """
    values = sets.select("id", F.size("set").alias("n"), F.explode("set").alias("v"))
    held = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    one = Window.partitionBy("id")
    placed = values.join(held, "v").withColumns({"s": F.count("*").over(one), "i": F.row_number().over(one.orderBy("df", "v")) - 1}).withColumn("j", F.col("n") - F.col("s") + F.col("i"))
    return placed.where(100 * (F.col("n") - F.col("j")) >= PERCENT * F.col("n")).select("v", "id", "n", "j")


def meetings(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """Entries (x_, y_) of one value that are compared.

    If the first value that two sets of n and m values share has i and j rarer ones before it, they share
    min(n - i, m - j) at most, and need PERCENT / (100 + PERCENT) of n + m. So the smaller set must have the value among
    its rarest seventh, and the larger one be of a size that the smaller one's rest allows: sizes are cut into ranges, and
    a set meets those of its own range and the next. What most sets of a list share is not rare in them, so documents
    with a common passage hardly meet. A list whose sets are all in one component gives no pair; in others, those of
    the largest component don't meet each other, so a resolved group costs nothing however large it is.
    """
    entries = written(_labelled(prefixes, comps, "id"))
    main = entries.groupBy("v", "id_in").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "id_in")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("v", F.col("m.id_in").alias("main"))
    main = written(main)
    split = written(entries.join(_small(main), "v").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT))))
    discard(entries, main)
    x = split.where((100 + PERCENT) * (F.col("n") - F.col("j")) >= 2 * PERCENT * F.col("n")).select("v", F.explode(F.array("size", F.col("size") + 1)).alias("size"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "j", "id_in", "main")])
    y = split.select("v", "size", *[F.col(c).alias(f"y_{c}") for c in ("id", "n", "j", "id_in", "main")])
    outside = lambda s: F.col(f"{s}_id_in") != F.col(f"{s}_main")
    return x.where(outside("x")).join(y, ["v", "size"]).unionByName(x.where(~outside("x")).join(y.where(outside("y")), ["v", "size"]))


def pairs_across(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of different components that share a value of their prefixes, early enough for the overlap that they need."""
    left = lambda s: F.col(f"{s}_n") - F.col(f"{s}_j")
    smaller = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_id") < F.col("y_id")))
    enough = (100 + PERCENT) * F.least(left("x"), left("y")) >= PERCENT * (F.col("x_n") + F.col("y_n"))
    return meetings(prefixes, comps).where((F.col("x_id_in") != F.col("y_id_in")) & smaller & enough).select(*_pair(F.col("x_id"), F.col("y_id"))).distinct()


def links(docs: DataFrame, reps: DataFrame, *, repeated: bool = True, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between documents of different sets that join all similar ones, and the components that they make.

    Short inverted lists give all their pairs. In a long list each document is compared with a leader, the one
    with most values in long lists; while that leaves many pairs and joins many documents, those outside the
    leader's component choose a new one. So a large group of near copies costs a few comparisons for each
    document and not all pairs. A leader speaks for nobody but itself: all documents of long lists that hold more than one
    component in the end, resolved ones too (all documents if `exact`), are then joined exactly, by the rarest values of their full sets.
    """
    post = reps.select("id", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    shared = written(post.join(post.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "v"))
    lists = todo = _heavy_lists(shared)
    pairs, edges, used, few, before = _light_pairs(shared), None, [], FEW_PAIRS * reps.count(), math.inf
    for _ in range(ROUNDS):
        lead = todo.groupBy("v").agg(F.min(F.struct(-F.col("h"), "id", "n")).alias("l"), F.count("*").alias("size")).where("size > 1").select("v", F.col("l.id").alias("leader"), F.col("l.n").alias("ln"))
        lead = written(lead)
        star = todo.join(_small(lead), "v").where((F.col("id") != F.col("leader")) & _alike(F.col("n"), F.col("ln"))).select(*_pair(F.col("id"), F.col("leader")))
        found = verify((star if edges is not None else star.union(pairs)).distinct(), reps, docs, repeated)
        edges = found if edges is None else written(edges.union(found).distinct())
        comps = components(edges)
        led = written(_labelled(lead, comps, "leader").select("v", "leader_in"))
        used += [lead, led, todo]
        todo = written(_labelled(todo, comps, "id").join(_small(led), "v").where(F.col("id_in") != F.col("leader_in")).select("v", "id", "n", "h"))
        sizes = todo.groupBy("v").count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        now = sizes[0] or 0
        if now > before * 3 / 4 or (sizes[1] or 0) <= few:
            break
        before = now
    open_lists = written(_labelled(lists, comps, "id").groupBy("v").agg(F.min("id_in").alias("p"), F.max("id_in").alias("q")).where("p != q").select("v"))
    if exact or not open_lists.isEmpty():
        ids = written(reps.select("id") if exact else lists.join(_small(open_lists), "v", "left_semi").select("id").distinct())
        sets = written(_full_sets(docs, ids, repeated))
        more = written(_similar(pairs_across(ordered_prefixes(sets), comps), sets))
        discard(ids, sets)
        if not more.isEmpty():
            edges = written(edges.union(more).distinct())
            comps = components(edges)
    discard(shared, todo, open_lists, *used)
    return edges, comps


def _grouped(docs: DataFrame, doc_id: str, text: str, exact: bool) -> tuple[DataFrame, DataFrame | None]:
    """(id, n, class, component) of each row, and a written table of the ids that several rows have (None if there are none)."""
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.col(quoted(text)).alias("text"))
    sketched = written(sketch(given))
    named = sketched.where(F.col("class").isNotNull() & F.col("id").isNotNull())
    repeated = written(sketched.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("rows"), F.min("class").alias("c"), F.max("class").alias("d")).where("rows > 1"))
    if repeated.isEmpty():
        repeated = None
    reps = written(named.groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    edges, comps = links(given, reps, repeated=repeated is not None, exact=exact)
    rep_of = reps.select("class", F.col("id").alias("rep"))
    if repeated is not None:  # rows of one id but different texts are linked, too
        twice = repeated.where("c != d").select("id")
        same = written(named.join(_small(twice), "id", "left_semi").select("id", "class").distinct().join(rep_of, "class").select(*_pair(F.col("id"), F.col("rep"))).where("a != b").distinct())
        if not same.isEmpty():
            comps = components(edges.union(same))
    final = rep_of.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    return sketched.select("id", "n", "class").join(final, "class", "left").select("id", "n", "class", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component")), repeated


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    Words are those between white space, A-Z lower-cased; sets are of 5-word shingles. A document without words, or
    whose text is null, is linked with nothing. Equal sets are one class; links between classes are confirmed on full
    sets. With sketches of 24 values, a link at similarity 0.75 of sets beyond 24 values goes unseen with a chance of 3.3e-9
    (fewer than five of the union's 24 smallest hashes in common); with `exact` all full sets are joined besides, and none
    does. Rows that share an id are one document. A row without an id can't be named: its component is null and it is
    kept. Repeated rows come out as often as they are in docs; ties go to the smallest id. A text is taken whole,
    however long; a task holds the sets of 256 texts at a time. An empty table gives no rows. Other columns of docs are not read.
    """
    rows, _ = _grouped(docs, doc_id, text, exact)
    out = rows.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(quoted(doc_id)) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id, with its columns untouched.

    Of rows that share an id, the one whose text and other columns hash lowest stays. Rows without an id, which
    no group can hold, all stay, and so do documents without words. Columns may have any name.
    """
    rows, repeated = _grouped(docs, doc_id, text, exact)
    key, place = fresh(docs, "known_id", "row_of_id")
    known = F.col(quoted(doc_id)).cast("long") == F.col(key)
    dropped = written(rows.where(F.col("id") != F.col("component")).select(F.col("id").alias(key)).distinct())
    out = docs.join(_small(dropped), known, "left_anti")
    if repeated is None:
        return out
    several = repeated.select(F.col("id").alias(key))
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    order = Window.partitionBy(F.col(quoted(doc_id)).cast("long")).orderBy(F.xxhash64(F.col(quoted(text))), F.xxhash64(*own(docs)))
    first = out.join(several, known, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).select(*own(docs))
    return out.join(several, known, "left_anti").unionByName(first)


def oracle() -> str:
    ws = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, {ws} AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
    bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, bi.b FROM r JOIN bi ON r.b = bi.a),
    k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)"""
