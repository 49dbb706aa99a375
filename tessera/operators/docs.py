"""Document collections: docs(doc_seq BIGINT, doc_id STRING, body VARIANT). Find, count, projections, mutations, index and constraint checks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CommandError
from tessera.functions.predicates import Typed, Variant, compile_where
from tessera.functions.predicates import where as where_
from tessera.operators.order import lookup, numbered
from tessera.plans.where import Find

SCHEMA = "doc_seq long, doc_id string, body variant"


# --- over typed tables (columns are the paths; seq orders what no ORDER BY orders)


def leaf(df: DataFrame, path: str) -> bool:
    """Whether a path names a column or struct field that isn't a struct itself."""
    kind = Typed(df.schema)._kind(path)
    return kind is not None and not isinstance(kind, T.StructType)


def _project(df: DataFrame, paths: tuple[str, ...]) -> list[Column]:
    """Columns of the leaf paths among `paths`, nested ones within their structs; others give nothing."""
    tree: dict = {}
    for p in paths:
        if leaf(df, p):
            at = tree
            *parents, last = p.split(".")
            for x in parents:
                at = at.setdefault(x, {})
            at[last] = p
    build = lambda node, name: (Typed._column(node) if isinstance(node, str) else F.struct(*[build(v, k) for k, v in node.items()])).alias(name)
    return [build(v, k) for k, v in tree.items()]


def find(df: DataFrame, q: Find, seq: str) -> DataFrame:
    """WHERE, then ORDER BY (missing last; first under DESC), then OFFSET and LIMIT, then PROJECT. Ties and unordered results follow seq."""
    out = where_(df, q.where)
    order = [F.col(seq).asc()]
    if q.order_by and leaf(df, q.order_by):
        c = Typed._column(q.order_by)
        order.insert(0, c.desc_nulls_first() if q.descending else c.asc_nulls_last())
    if q.order_by or q.limit is not None or q.offset:
        out = out.orderBy(*order)
        out = out.offset(q.offset) if q.offset else out
        out = out.limit(q.limit) if q.limit is not None else out
    return out.select(*_project(df, q.project)) if q.project else out


def count(df: DataFrame, where: str) -> DataFrame:
    return where_(df, where).agg(F.count("*").alias("n"))


# --- over VARIANT bodies

def _sort_keys(path: str) -> list[Column]:
    """Present values by kind (null, boolean, number, string, other), then value. Mixed kinds are so in a fixed order, which is ours."""
    v = F.try_variant_get("body", "$." + path, "variant")
    kind = F.schema_of_variant(v)
    rank = F.when(kind == "VOID", 0).when(kind == "BOOLEAN", 1).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), 2).when(kind == "STRING", 3).when(v.isNotNull(), 4)
    return [rank, F.when(rank == 1, F.try_variant_get(v, "$", "boolean")), F.when(rank == 2, F.try_variant_get(v, "$", "double")), F.when(rank == 3, F.try_variant_get(v, "$", "string"))]


def find_variant(docs: DataFrame, q: Find) -> DataFrame:
    """As find; with PROJECT, (doc_seq, doc_id) and one VARIANT column for each path."""
    out = where_(docs, q.where, "body")
    order = [F.asc("doc_seq")]
    if q.order_by:
        order = [c.desc_nulls_first() if q.descending else c.asc_nulls_last() for c in _sort_keys(q.order_by)] + order
    if q.order_by or q.limit is not None or q.offset:
        out = out.orderBy(*order)
        out = out.offset(q.offset) if q.offset else out
        out = out.limit(q.limit) if q.limit is not None else out
    if q.project:
        out = out.select("doc_seq", "doc_id", *[F.try_variant_get("body", "$." + p, "variant").alias(p) for p in q.project])
    return out


def count_variant(docs: DataFrame, where: str) -> DataFrame:
    return where_(docs, where, "body").agg(F.count("*").alias("n"))


def checked_body(text: Column) -> Column:
    """A VARIANT of JSON text whose root must be an object; empty names and names with dots are refused."""
    v = F.try_parse_json(text)
    bad_name = text.rlike(r'"[^"\\]*\.[^"\\]*"\s*:|""\s*:')
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & ~bad_name
    return F.when(ok, v).otherwise(F.raise_error(F.concat(F.lit("ERR not a document: "), F.coalesce(text, F.lit("null")))))


def set_(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of new(doc_id, json[, pos]), the last of a repeated id winning. A present document keeps its place; new ones follow the last, in the order of pos and id."""
    new_pos = "pos" in new.columns
    if not new_pos:
        new = new.withColumn("pos", F.lit(0))
    new = new.groupBy("doc_id").agg(F.max_by("json", "pos").alias("json"), F.min("pos").alias("pos"))
    old = docs.select("doc_id", "doc_seq")
    same = new.join(old, "doc_id").select("doc_seq", "doc_id", checked_body(F.col("json")).alias("body"))
    fresh = new.join(old, "doc_id", "left_anti")
    top = docs.agg(F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("top"))
    added = numbered(fresh, "rn", F.col("pos"), "doc_id") if new_pos else numbered(fresh, "rn", F.col("doc_id"))
    added = added.join(F.broadcast(top), F.lit(True)).select((F.col("top") + 1 + F.col("rn")).cast("long").alias("doc_seq"), "doc_id", checked_body(F.col("json")).alias("body"))  # one row
    return docs.join(new, "doc_id", "left_anti").select("doc_seq", "doc_id", "body").unionByName(same).unionByName(added)


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of new(ord, json) with decimal ids after the last internal number."""
    top = docs.agg(F.coalesce(F.max("doc_seq"), F.lit(-1)).alias("top"))
    named = numbered(new, "rn", F.col("ord")).join(F.broadcast(top), F.lit(True)).select((F.col("top") + 1 + F.col("rn")).cast("string").alias("doc_id"), "json", F.col("ord").alias("pos"))  # one row
    return set_(docs, named)


def get(docs: DataFrame, req: DataFrame) -> DataFrame:
    """(pos, doc_id, json) of each request, null where there is none. Also DOC.MGET."""
    return lookup(req, docs, "doc_id").select("pos", "doc_id", F.to_json("body").alias("json"))


def delete(docs: DataFrame, req: DataFrame) -> DataFrame:
    return docs.join(req, "doc_id", "left_anti")


def exists(docs: DataFrame, req: DataFrame) -> DataFrame:
    there = docs.select("doc_id", F.lit(1).alias("there"))
    return lookup(req, there, "doc_id").select("pos", "doc_id", F.coalesce("there", F.lit(0)).cast("long").alias("present"))


def mutate(doc: dict, ops: list[tuple]) -> dict:
    """A copy of a document after SET, DEL, INCR, PUSH and PULL steps in order; a step that can't be done is an error, and then none is."""
    doc = json.loads(json.dumps(doc))

    def parent(path: str, make: bool) -> tuple[dict | None, str]:
        at, *rest = doc, *path.split(".")
        for name in rest[:-1]:
            if name not in at:
                if not make:
                    return None, rest[-1]
                at[name] = {}
            at = at[name]
            if not isinstance(at, dict):
                raise CommandError(f"ERR {path} goes through a value that is no object")
        return at, rest[-1]

    for op, path, *arg in ops:
        at, name = parent(path, op in ("SET", "PUSH"))
        if op == "SET":
            at[name] = arg[0]
        elif op == "DEL":
            if at is not None:
                at.pop(name, None)
        elif op == "INCR":
            old = at.get(name) if at is not None else None
            if isinstance(old, bool) or not isinstance(old, int | float):
                raise CommandError(f"ERR {path} is not a number")
            new = old + arg[0]
            at[name] = int(new) if float(new).is_integer() and abs(new) < 2**63 else new
        elif op == "PUSH":
            held = at.setdefault(name, [])
            if not isinstance(held, list):
                raise CommandError(f"ERR {path} is not an array")
            held.append(arg[0])
        elif op == "PULL":
            held = at.get(name, []) if at is not None else []
            if not isinstance(held, list):
                raise CommandError(f"ERR {path} is not an array")
            if at is not None and name in at:
                at[name] = [x for x in held if type(x) is not type(arg[0]) or x != arg[0]]
        else:
            raise CommandError(f"ERR unknown mutation {op}")
    return doc


def update(docs: DataFrame, ops: list[tuple], where: str | None = None) -> DataFrame:
    """docs with the steps applied to all documents, or to those that meet an expression. Arrow batches of JSON; untouched documents don't leave the JVM."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda s: json.dumps(mutate(json.loads(s), ops)))

    hit = compile_where(where, Variant("body")) if where else F.lit(True)
    changed = docs.where(hit).select("doc_seq", "doc_id", F.parse_json(apply(F.to_json("body"))).alias("body"))
    return docs.where(~hit).select("doc_seq", "doc_id", "body").unionByName(changed) if where else changed


def leaves(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(doc_seq, path, value VARIANT) of present paths."""
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get("body", "$." + p, "variant").alias("value")) for p in paths])
    return docs.select("doc_seq", F.explode(each).alias("x")).select("doc_seq", "x.path", "x.value").where(F.col("value").isNotNull())


def dictionary_info(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(path, cardinality): distinct string values of each path."""
    strings = leaves(docs, paths).where(F.schema_of_variant("value") == "STRING")
    return strings.groupBy("path").agg(F.countDistinct(F.try_variant_get("value", "$", "string")).alias("cardinality"))


def storage_info(docs: DataFrame) -> DataFrame:
    """(doc_count, total_bytes, min_bytes, max_bytes, avg_bytes) of the bodies as JSON; the average is a whole number."""
    n = F.octet_length(F.to_json("body"))
    return docs.agg(F.count("*").alias("doc_count"), F.sum(n).cast("long").alias("total_bytes"), F.min(n).cast("long").alias("min_bytes"), F.max(n).cast("long").alias("max_bytes"), F.floor(F.sum(n) / F.count("*")).alias("avg_bytes"))


def unique_violations(docs: DataFrame, path: str) -> DataFrame:
    """(value, n): values of a path that several documents hold; 1 and 1.0 are one value."""
    held = leaves(docs, [path])
    return held.groupBy(F.to_json("value").alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def create_index(indexes: DataFrame, docs: DataFrame, collection: str, path: str, kind: str) -> DataFrame:
    """indexes(collection, path, kind) with one more. A unique index needs a path without repeated values. hash, sorted and array are layout hints (see layout)."""
    if kind not in ("hash", "sorted", "array", "unique"):
        raise CommandError("ERR unknown index type")
    if not indexes.where((F.col("collection") == collection) & (F.col("path") == path)).isEmpty():
        raise CommandError("ERR index already exists")
    if kind == "unique" and not unique_violations(docs, path).isEmpty():
        raise CommandError("ERR unique constraint violation")
    return indexes.unionByName(docs.sparkSession.createDataFrame([(collection, path, kind)], indexes.schema))


def drop_index(indexes: DataFrame, collection: str, path: str) -> DataFrame:
    here = (F.col("collection") == collection) & (F.col("path") == path)
    if indexes.where(here).isEmpty():
        raise CommandError("ERR no such index")
    return indexes.where(~here)


def store_layout(df: DataFrame, path: str, kind: str, partitions: int, folder: str) -> None:
    """Writes a typed table as an index on a path lays it out: hash in folders by the path's hash, which a seek names; sorted in files of ascending ranges, which a range skips by their smallest and largest values."""
    laid = layout(df, path, kind, partitions)
    if kind in ("hash", "unique"):
        laid.withColumn(BUCKET, _bucket(Typed._column(path), partitions)).write.partitionBy(BUCKET).parquet(folder)
    else:
        laid.write.parquet(folder)


def seek(laid: DataFrame, path: str, value: object, partitions: int) -> DataFrame:
    """Rows of a stored hash layout whose path has a value, from one folder."""
    v = F.lit(value).cast(laid.schema[path].dataType)
    at = laid.sparkSession.range(1).select(_bucket(v, partitions)).first()[0]
    return laid.where((F.col(BUCKET) == at) & (Typed._column(path) == v)).drop(BUCKET)


BUCKET = "_bucket"


def _bucket(c: Column, partitions: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(partitions)).cast("int")


def layout(df: DataFrame, path: str, kind: str, partitions: int) -> DataFrame:
    """A typed table laid out for an index: hash deals rows by the path, sorted ranges and sorts them, so that Parquet's min/max skip row groups."""
    c = Typed._column(path)
    return df.repartition(partitions, c).sortWithinPartitions(c) if kind in ("hash", "unique") else df.repartitionByRange(partitions, c).sortWithinPartitions(c)
