"""Shared helpers of the training-data operators: text classes, the shared folder, native let-bindings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: space and U+0009 to U+000D.
SPACE_RE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    inner = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RE))


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once.

    A plain column that a lambda captures may be inlined by the optimizer and so be evaluated for
    each element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def window_hashes(hashes: Column, n: int) -> Column:
    """Hashes of all windows of n words, from the words' hashes (n at least).

    The hashes of 2, 4, 8.. words come from those of half as many, and the last step joins the two that cover the n words
    from either end: each word is hashed once for each doubling and not once for each window that it is in.
    """

    def joined(h: Column, shift: int) -> Column:
        return F.zip_with(h, F.slice(h, shift + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))  # the last ones are cut off below

    def grow(h: Column, width: int) -> Column:
        if width == n:
            return F.slice(h, 1, F.size(h) - n + 1)
        wider = min(2 * width, n)
        return let(joined(h, wider - width), lambda w: grow(w, wider))

    return grow(hashes, 1)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text falls in fold 0; a null id is in no fold and so isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written as a table to the shared folder and read again: cuts lineage, survives lost executors.

    The table goes when it is discarded, or else with the application, as a lazy result may still read it.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            fs, where = _at(t.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def own(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Rows of an Arrow batch. Documents can be long, so that Spark's default of 10,000 would hold tens of MB for each task in both processes.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
