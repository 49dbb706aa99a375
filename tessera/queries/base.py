"""Registration of queries with their SQL, and the tables that tests and benchmarks run them on."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The clock of all queries.
NOW = datetime(2024, 1, 16)


def query(sql: str | None = None):
    """Registers a function of T under its name, and the SQL that gives the same rows."""

    def wrap(f: Callable[[T], DataFrame]) -> Callable[[T], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(T(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH {SQL_TABLES.strip()}{sql if sql.startswith(",") else chr(10) + sql}"
        return f

    return wrap


#: The canonical tables of T in SQL.
SQL_TABLES = """
kv AS (SELECT c_name AS key, c_mktsegment || '-' || c_custkey AS value, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (c_custkey % 31) DAY END AS expire_at FROM customer),
live AS (SELECT * FROM kv WHERE expire_at IS NULL OR expire_at > TIMESTAMP '2024-01-16'),
counters AS (SELECT c_name AS key, CAST(c_custkey * 7 AS VARCHAR) AS value, CAST(NULL AS TIMESTAMP) AS expire_at FROM customer),
hash_fields AS (SELECT 'nation:' || n_nationkey AS key, f AS field, CASE f WHEN 'name' THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS value FROM nation, (VALUES ('name'), ('region')) t(f)),
set_members AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders),
zset AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer),
list_items AS (SELECT conv_id AS key, turn AS pos, role AS value FROM conversations),
stream_entries AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) - 1 AS seq, event_id, user_id, value AS val FROM events),
stream_pel AS (SELECT key, 'g' AS "group", 'c' || (user_id % 5) AS consumer, ms, seq, ms + user_id * 10 AS delivered_ms, 1 + user_id % 3 AS deliveries FROM stream_entries),
bits AS (SELECT DISTINCT event_type AS key, user_id AS "offset" FROM events),
geo AS (SELECT c_mktsegment AS key, c_name AS member, ((c_custkey * 7919) % 360000) / 1000.0 - 180 AS lon, ((c_custkey * 104729) % 170000) / 1000.0 - 85 AS lat FROM customer)
"""


class T:
    """Canonical tables over the Parquet files of a folder. Each is a lazy view; a query scans the columns that it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        """A table of request arguments."""
        return self.spark.createDataFrame(data, schema)

    @property
    def kv(self) -> DataFrame:
        c = self.customer
        at = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((F.col("c_custkey") % 31).cast("int"))
        return c.select(F.col("c_name").alias("key"), F.concat_ws("-", "c_mktsegment", "c_custkey").cast("binary").alias("value"), F.when(F.col("c_custkey") % 3 == 0, at).alias("expire_at"))

    @property
    def counters(self) -> DataFrame:
        return self.customer.select(F.col("c_name").alias("key"), (F.col("c_custkey") * 7).cast("string").cast("binary").alias("value"), F.lit(None).cast("timestamp").alias("expire_at"))

    @property
    def hash_fields(self) -> DataFrame:
        n = self.nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("key"), "n_name", F.col("n_regionkey").cast("string").alias("r"))
        return n.selectExpr("key", "stack(2, 'name', n_name, 'region', r) as (field, value)")

    @property
    def set_members(self) -> DataFrame:
        return self.orders.select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).distinct()

    @property
    def zset(self) -> DataFrame:
        return self.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))

    @property
    def list_items(self) -> DataFrame:
        return self.conversations.select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))

    @property
    def stream_entries(self) -> DataFrame:
        e = self.events.select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "user_id", F.col("value").alias("val"))
        return e.withColumn("seq", F.expr("row_number() over (partition by key, ms order by event_id) - 1").cast("long")).select("key", "ms", "seq", "event_id", "user_id", "val")

    @property
    def stream_pel(self) -> DataFrame:
        e = self.stream_entries
        return e.select("key", F.lit("g").alias("group"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("consumer"), "ms", "seq", (F.col("ms") + F.col("user_id") * 10).alias("delivered_ms"), (1 + F.col("user_id") % 3).alias("deliveries"))

    @property
    def bits(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("offset")).distinct()

    @property
    def geo(self) -> DataFrame:
        lon = ((F.col("c_custkey") * 7919) % 360000) / 1000.0 - 180
        lat = ((F.col("c_custkey") * 104729) % 170000) / 1000.0 - 85
        return self.customer.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), lon.alias("lon"), lat.alias("lat"))

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.lit("main").alias("index"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    @property
    def props(self) -> DataFrame:
        """docs(doc_seq, doc_id, body VARIANT) of the events' JSON."""
        return self.events.select(F.col("event_id").alias("doc_seq"), F.col("event_id").cast("string").alias("doc_id"), F.parse_json("props").alias("body"))
