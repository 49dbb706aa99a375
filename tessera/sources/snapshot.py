"""Snapshots and change logs in Parquet, and JSON lines as documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.operators.order import numbered


#: The file that makes a version of a snapshot whole.
COMPLETE = "_COMPLETE"


def _fs(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _folders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the sub-folders that begin so, in order."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(folder)):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(path(folder)) if x.isDirectory() and x.getPath().getName().startswith(prefix))


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Whole versions of a snapshot, oldest first."""
    fs, path = _fs(spark, folder)
    return [v for v in _folders(spark, folder, "version-") if fs.exists(path(f"{folder}/{v}/{COMPLETE}"))]


def save(tables: dict[str, DataFrame], folder: str, keep: int = 2) -> str:
    """A new version with each table as one Parquet directory; returns its folder.

    A version counts from the moment that its last file, an empty one, is there: until then, and for ever if the
    writer dies, `load` reads the version before. Tables may come from any version of the same folder. Then whole versions
    beyond the newest `keep` are deleted, and what is left of versions that never became whole.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, path = _fs(spark, folder)
    number = 1 + max([int(v.split("-")[1]) for v in _folders(spark, folder, "version-")], default=0)
    new = f"version-{number:08d}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{new}/{name}")
    fs.create(path(f"{folder}/{new}/{COMPLETE}"), False).close()
    whole = versions(spark, folder)
    for v in _folders(spark, folder, "version-"):
        if v not in whole[-max(1, keep) :]:
            fs.delete(path(f"{folder}/{v}"), True)
    return f"{folder}/{new}"


def load(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the newest whole version, all of them or those named."""
    found = versions(spark, folder)
    if not found:
        raise CommandError(f"ERR no snapshot in {folder}")
    at = f"{folder}/{found[-1]}"
    return {n: spark.read.parquet(f"{at}/{n}") for n in (names if names is not None else _folders(spark, at, ""))}


# --- change logs: folders segment-N of changes(seq, ts_ms, op, key, value) with a checksum


def _checksum() -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in ("seq", "ts_ms", "op", "key", "value")]
    return F.crc32(F.concat(*parts).cast("binary"))


def segments(spark: SparkSession, folder: str) -> list[str]:
    return _folders(spark, folder, "segment-")


def append_log(changes: DataFrame, folder: str) -> None:
    """Adds changes(seq, ts_ms, op, key, value), with checksums, to the newest segment of a log, within it by operation."""
    last = (segments(changes.sparkSession, folder) or ["segment-00000001"])[-1]
    changes.select("seq", "ts_ms", "op", "key", "value", _checksum().alias("crc")).write.mode("append").partitionBy("op").parquet(f"{folder}/{last}")


def rotate(spark: SparkSession, folder: str) -> str:
    """Opens the next segment, to which changes are added from now on."""
    held = segments(spark, folder)
    new = f"segment-{(int(held[-1].split('-')[1]) if held else 0) + 1:08d}"
    fs, path = _fs(spark, folder)
    fs.mkdirs(path(f"{folder}/{new}"))
    return new


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = spark.createDataFrame([], "seq long, ts_ms long, op string, key string, value string, crc long")
    fs, path = _fs(spark, paths[0]) if paths else (None, None)
    for p in paths:
        if any(True for x in fs.listStatus(path(p)) if x.getPath().getName().startswith("op=")):
            out = out.unionByName(spark.read.schema("seq long, ts_ms long, key string, value string, crc long, op string").parquet(p))
    return out


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log's changes up to the first, by sequence number, whose checksum is wrong."""
    log = _read(spark, [f"{folder}/{s}" for s in segments(spark, folder)])
    bad = log.where(~F.col("crc").eqNullSafe(_checksum())).agg(F.min("seq").alias("bad"))
    return log.join(F.broadcast(bad), F.col("bad").isNull() | (F.col("seq") < F.col("bad"))).select("seq", "ts_ms", "op", "key", "value")  # one row


def truncate(spark: SparkSession, folder: str, seq: int) -> list[str]:
    """Deletes closed segments all of whose changes are at or before a sequence number, as a snapshot makes them needless; their names."""
    gone, (fs, path) = [], _fs(spark, folder)
    for s in segments(spark, folder)[:-1]:
        last = _read(spark, [f"{folder}/{s}"]).agg(F.max("seq")).first()[0]
        if last is None or last <= seq:
            fs.delete(path(f"{folder}/{s}"), True)
            gone.append(s)
    return gone


def rewrite(spark: SparkSession, folder: str) -> None:
    """Replaces a log by the shortest one of the same effect (BGREWRITEAOF). The short log is written as a segment of its own before the
    old ones go; a replay of both has the same effect, so nothing is lost if the writer dies between."""
    old = segments(spark, folder)
    short = compact(read_log(spark, folder))
    rotate(spark, folder)
    append_log(short, folder)
    fs, path = _fs(spark, folder)
    for s in old:
        fs.delete(path(f"{folder}/{s}"), True)


def replay(log: DataFrame) -> DataFrame:
    """kv(key, value) after a log of SET and DEL: the last change of each key decides, FLUSHDB forgets all before it. One aggregate, no replay in order."""
    flush = log.where(F.col("op") == "FLUSHDB").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("cut"))
    live = log.join(F.broadcast(flush), F.col("seq") > F.col("cut")).where(F.col("op").isin("SET", "DEL"))  # one row
    last = live.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("c"))
    return last.where(F.col("c.op") == "SET").select("key", F.col("c.value").alias("value"))


def compact(log: DataFrame) -> DataFrame:
    """The shortest log of the same effect: one SET for each surviving key, with its sequence number."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    kept = replay(log).select("key")
    return log.where(F.col("op") == "SET").join(kept, "key", "left_semi").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn").select("seq", "ts_ms", "op", "key", "value")


def read_documents(spark: SparkSession, path: str, id_field: str | None = None) -> DataFrame:
    """docs(doc_seq, doc_id, body VARIANT) of JSON lines. doc_seq follows files and lines."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = numbered(lines, "doc_seq", F.col("_at")) if id_field is None else lines.withColumnRenamed("_at", "doc_seq")
    out = lines.select("doc_seq", F.parse_json("value").alias("body"))
    name = F.try_variant_get("body", f"$.{id_field}", "string") if id_field else F.col("doc_seq").cast("string")
    return out.select("doc_seq", name.alias("doc_id"), "body")


def retention(snapshots: list[tuple[str, datetime]], keep: int) -> list[str]:
    """Paths of the snapshots beyond the newest `keep`."""
    return [p for p, _ in sorted(snapshots, key=lambda s: s[1], reverse=True)[keep:]]
