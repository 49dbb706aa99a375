"""Vectors: a table vectors(index, id BIGINT, vec ARRAY<FLOAT>). Exact nearest neighbours for three metrics; an inverted file of cells for approximate search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a norm is near zero."""
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(n < 1e-12, 1.0).otherwise(1 - _dot(a, b) / n)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -_dot(a, b)


METRICS = {"l2": l2, "cosine": cosine, "ip": negative_inner_product}


def vecset(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with new(index, vec): the id is a hash of the values, so equal vectors are one. A dimension unlike the index's is an error."""
    dims = vectors.unionByName(new.select("index", F.lit(0).cast("long").alias("id"), "vec")).groupBy("index").agg(F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi"))
    bad = dims.where("lo != hi").select("index", F.lit(True).alias("bad"))
    made = new.join(bad, "index", "left")
    made = made.select("index", F.when(F.col("bad"), F.raise_error(F.lit("ERR vector dimension mismatch"))).otherwise(F.xxhash64("vec")).alias("id"), "vec")
    return vectors.unionByName(made.dropDuplicates(["index", "id"]).join(vectors, ["index", "id"], "left_anti"))


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", index: str | None = None) -> DataFrame:
    """(id, distance) of the k nearest: each task keeps its k, then they meet."""
    if metric not in METRICS:
        raise CommandError("ERR unknown metric")
    some = vectors if index is None else vectors.where(F.col("index") == index)
    q = F.array(*[F.lit(float(x)) for x in query])
    return some.select("id", METRICS[metric](F.col("vec"), q).alias("distance")).orderBy("distance", "id").limit(k)


#: Queries of a block, which is broadcast (with 64 values about 30 MB).
QUERY_BLOCK = 50_000


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(qid, id, distance, rank) of the k nearest of each query(qid, vec).

    Queries go to the vectors in blocks of a bounded size; the window keeps k rows of each query in the task
    that made them, and only those are shuffled.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    d = METRICS[metric](F.col("vec"), F.col("q"))
    w = Window.partitionBy("qid").orderBy("distance", "id")
    out = None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else queries
        pairs = vectors.select("id", "vec").crossJoin(F.broadcast(block.select("qid", F.col("vec").alias("q")))).where(F.size("vec") == F.size("q"))
        near = pairs.select("qid", "id", d.alias("distance")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = near if out is None else out.unionByName(near)
    return out


def vecdel(vectors: DataFrame, index: str) -> DataFrame:
    """vectors without a whole index."""
    return vectors.where(F.col("index") != index)


#: Vectors, chosen by a hash of their ids, that centroids are fitted on, and the rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 10_000, 8
#: Cells that a search looks into. Vectors without groups, such as random ones of 64 values, need 12 of 16 for nine tenths of their neighbours; grouped ones far fewer.
PROBES = 12


def centroids(vectors: DataFrame, cells: int) -> list[list[float]]:
    """Means of at most `cells` groups of vectors (k-means) over a sample of at most FIT_ROWS of them, equal vectors once."""
    n = vectors.count()
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    some = vectors if n <= FIT_ROWS else vectors.where(h < FIT_ROWS / n * (1 << 30))
    rows = [r[0] for r in some.select("vec", h.alias("h"), "id").limit(2 * FIT_ROWS).orderBy("h", "id").select("vec").collect()]
    x = np.unique(np.array(rows, np.float64), axis=0) if rows else np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else x
    for _ in range(FIT_ROUNDS if len(c) else 0):
        near = _distances(x, c).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c.tolist()


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


class CellIndex:
    """An inverted file: every vector in the cell of its nearest centroid, a query in the `probes` nearest cells.

    `store` writes the vectors by cell, once; a search of a stored index reads only the folders of its cells. Distances to
    centroids are Euclidean whatever the metric. With as many probes as cells the search is exact.
    """

    def __init__(self, vectors: DataFrame, cells: int = 16, metric: str = "l2", means: list[list[float]] | None = None) -> None:
        self.metric = METRICS[metric]
        self.centroids = centroids(vectors, cells) if means is None else means
        self.rows = vectors if "cell" in vectors.columns else vectors.withColumn("cell", self._cells(F.col("vec"), 1)[0])

    def store(self, folder: str) -> None:
        self.rows.write.partitionBy("cell").parquet(f"{folder}/rows")
        self.rows.sparkSession.createDataFrame(list(enumerate(self.centroids)), "cell int, mean array<double>").coalesce(1).write.parquet(f"{folder}/means")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, metric: str = "l2") -> CellIndex:
        means = [r["mean"] for r in spark.read.parquet(f"{folder}/means").orderBy("cell").collect()]
        return cls(spark.read.parquet(f"{folder}/rows"), metric=metric, means=means)

    def _cells(self, v: Column, n: int) -> Column:
        """The n nearest cells of a vector: one array of all means, and the least of the distances to them."""
        if not self.centroids:
            return F.array(F.lit(0))
        means = F.array(*[F.array(*map(F.lit, c)) for c in self.centroids])
        ds = F.transform(means, lambda c, i: F.struct(l2(v, c).alias("d"), i.cast("int").alias("i")))
        return F.transform(F.array(F.array_min(ds)) if n == 1 else F.slice(F.array_sort(ds), 1, n), lambda s: s["i"])

    def search(self, query: list[float], k: int, probes: int = PROBES) -> DataFrame:
        """(id, distance) of the k nearest in the query's cells."""
        cells = _distances(np.array([query], np.float64), np.array(self.centroids))[0].argsort()[:probes].tolist() if self.centroids else [0]
        return knn(self.rows.where(F.col("cell").isin(cells)), query, k, _name(self.metric))

    def join(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(qid, id, distance, rank) of the k nearest of each query(qid, vec) in its cells: an equality join by cell, of which Spark splits the large ones."""
        asked = queries.select("qid", F.col("vec").alias("q"), F.explode(self._cells(F.col("vec"), min(probes, max(1, len(self.centroids))))).alias("cell"))
        near = self.rows.select("id", "vec", "cell").join(asked, "cell").select("qid", "id", self.metric(F.col("vec"), F.col("q")).alias("distance"))
        w = Window.partitionBy("qid").orderBy("distance", "id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _name(metric) -> str:
    return next(k for k, f in METRICS.items() if f is metric)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): the share of true neighbours (qid, id) that were found."""
    return truth.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
