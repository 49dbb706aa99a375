"""A command interface over the canonical tables: Database.execute("ZRANGE", "k", "0", "-1").

Every write replaces a table by a transform of it; nothing is updated in place. Plans that grow are cut by a checkpoint. For bulk
work use the operators with tables of arguments: one command is one Spark job here.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tessera.errors import CommandError, WrongType
from tessera.functions.text import byte_range, glob
from tessera.operators import bitmaps, docs, geo, hashes, keyspace, lists, sets, sketches, stats, streams, vectors, zsets
from tessera.plans import commands
from tessera.plans.where import parse_find
from tessera.sources import snapshot
from tessera.streaming import cdc, pubsub

SCHEMAS = {
    "kv": "key string, value binary, expire_at timestamp",
    "list_items": "key string, pos long, value string",
    "hash_fields": "key string, field string, value string",
    "set_members": "key string, member string",
    "zset": "key string, member string, score double",
    "stream_entries": "key string, ms long, seq long, fields array<struct<k:string,v:string>>",
    "stream_groups": "key string, `group` string, last_ms long, last_seq long",
    "stream_pel": "key string, `group` string, consumer string, ms long, seq long, delivered_ms long, deliveries long",
    "sketches": "key string, sketch binary",
    "geo": "key string, member string, lon double, lat double",
    "vectors": "index string, id long, vec array<float>",
    "cdc": cdc.SCHEMA,
    "cdc_groups": "`group` string, next_seq long",
    "cdc_pel": "`group` string, consumer string, seq long, delivered_ms long, deliveries long",
    "subscriptions": "conn string, kind string, pattern string",
    "indexes": "collection string, path string, kind string",
}
#: The tables whose keys are one keyspace, and the kind that TYPE names.
KINDS = {"kv": "string", "list_items": "list", "hash_fields": "hash", "set_members": "set", "zset": "zset", "stream_entries": "stream", "sketches": "string", "geo": "zset"}


#: Families whose first argument is a key.
KEYED = {"string", "list", "hash", "set", "zset", "stream", "hyperloglog", "bitmap", "geo"}


def _int(text: object) -> int:
    try:
        return int(str(text))
    except ValueError:
        raise CommandError("ERR value is not an integer or out of range") from None


def _float(text: object) -> float:
    out = zsets.parse_score(str(text))[0] if not str(text).startswith("(") else None
    if out is None:
        raise CommandError("ERR value is not a valid float")
    return out


def _number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


class Database:
    """Tables by name, a clock, and one method for each family of commands."""

    def __init__(self, spark: SparkSession, now: Callable[[], datetime] | None = None, cut_after: int = 8) -> None:
        """cut_after: writes to a table after which a checkpoint cuts its plan. Fewer suit small tables, more large ones."""
        self.spark, self.cut_after = spark, cut_after
        self.clock = now or (lambda: datetime.now(UTC).replace(tzinfo=None))
        self.t: dict[str, DataFrame] = {k: self.rows([], s) for k, s in SCHEMAS.items()}
        self.collections: dict[str, DataFrame] = {}
        self.created: dict[str, tuple[float, str]] = {}
        self.writes: dict[str, int] = {}
        self.queue: list[tuple] | None = None
        self.config = {"maxmemory": "0", "requirepass": ""}
        #: The newest commands with their milliseconds, and the newest accesses to keys.
        self.samples: deque[tuple[str, float]] = deque(maxlen=10_000)
        self.accesses: deque[str] = deque(maxlen=100_000)
        self.seq = 0

    # --- tables

    def rows(self, data: list[tuple], schema: str) -> DataFrame:
        """A table of a few rows as a local relation, which plans fold into and no task reads."""
        kind = _parse_datatype_string(schema)
        arrow = to_arrow_schema(kind)
        cols = zip(*data, strict=True) if data else [[] for _ in kind]
        plain = lambda v: [{"k": x[0], "v": x[1]} for x in v] if isinstance(v, list) and v and isinstance(v[0], tuple) else bytes(v) if isinstance(v, bytearray) else v
        arrays = [pa.array([v.replace(tzinfo=UTC) if isinstance(v, datetime) else plain(v) for v in c], f.type) for c, f in zip(cols, arrow, strict=True)]
        return self.spark.createDataFrame(pa.Table.from_arrays(arrays, names=arrow.names), kind)

    def put(self, name: str, df: DataFrame) -> None:
        """Replaces a table. Its plan is cut by a checkpoint now and then, if there is a folder for one."""
        self.writes[name] = self.writes.get(name, 0) + 1
        if self.writes[name] % self.cut_after == 0 and (self.spark.sparkContext.getConf().get("spark.checkpoint.dir") or self.spark.sparkContext.getCheckpointDir()):
            df = df.checkpoint()
        self.t[name] = df

    def save(self, folder: str) -> None:
        """Every table as Parquet (BGSAVE), in a new version of the folder; the tables go on from there, with short plans."""
        snapshot.save({**self.t, **{f"docs_{k}": v.withColumn("body", F.to_json("body")) for k, v in self.collections.items()}}, folder)
        self.t, self.collections = self._saved(self.spark, folder)

    @staticmethod
    def _saved(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        held = snapshot.load(spark, folder)
        docs_of = {k[5:]: v.withColumn("body", F.parse_json("body")) for k, v in held.items() if k.startswith("docs_")}
        return {k: held[k] for k in SCHEMAS}, docs_of

    @classmethod
    def load(cls, spark: SparkSession, folder: str, collections: list[str] | None = None, now: Callable[[], datetime] | None = None) -> Database:
        """The newest whole version in a folder, with all its collections or those named."""
        db = cls(spark, now)
        db.t, held = cls._saved(spark, folder)
        db.collections = {c: held[c] for c in (held if collections is None else collections)}
        db.created = {c: (time.time(), "balanced") for c in db.collections}
        return db

    def now_ms(self) -> int:
        return int((self.clock() - datetime(1970, 1, 1)).total_seconds() * 1000)

    def kind(self, key: str) -> str | None:
        """The table that holds a key, expired strings aside: one job over all tables, filtered by the key."""
        held = [(self.live() if k == "kv" else self.t[k]).where(F.col("key") == key).select(F.lit(k).alias("t")).limit(1) for k in KINDS]
        out = held[0]
        for h in held[1:]:
            out = out.unionByName(h)
        got = out.head(1)
        return got[0][0] if got else None

    def own(self, name: str, key: str) -> DataFrame:
        """Rows of a key in a table; an error if another kind of value has the key."""
        held = self.kind(key)
        if held not in (None, name):
            raise WrongType
        return (self.live() if name == "kv" else self.t[name]).where(F.col("key") == key)

    def live(self) -> DataFrame:
        return keyspace.live(self.t["kv"], self.clock())

    def drop(self, keys: list[str]) -> int:
        n = 0
        for name in KINDS:
            hit = F.col("key").isin(keys)
            found = self.t[name].where(hit).select("key").distinct().count()
            if found:
                n += found
                self.put(name, self.t[name].where(~hit))
        return n

    # --- dispatch

    def execute(self, *args: object) -> object:
        """The reply of a command: None, int, float, str, bytes, list or dict; an error is raised."""
        words = [a.decode() if isinstance(a, bytes) else str(a) for a in args]
        if not words:
            raise CommandError("ERR empty command")
        name = words[0].upper()
        kind = commands.family(name)
        if kind is None:
            raise CommandError(f"ERR unknown command '{words[0]}'")
        if self.queue is not None and name not in ("EXEC", "DISCARD", "MULTI"):
            self.queue.append(args)
            return "QUEUED"
        began = time.perf_counter()
        if kind in KEYED and len(words) > 1:
            self.accesses.append(words[1])
        try:
            return getattr(self, f"_{kind}")(name, *words[1:])
        except CommandError:
            raise
        except (TypeError, IndexError, KeyError, ValueError) as e:
            raise CommandError(f"ERR wrong number of arguments for '{name.lower()}' command") from e
        finally:
            self.samples.append((name.lower(), 1000 * (time.perf_counter() - began)))

    # --- strings

    def _value(self, key: str) -> bytes | None:
        got = self.own("kv", key).select("value").head(1)
        return bytes(got[0][0]) if got else None

    def _store(self, pairs: list[tuple[str, bytes]], expire_at: datetime | None = None, mode: str | None = None) -> None:
        new = self.rows([(k, bytearray(v), expire_at) for k, v in pairs], SCHEMAS["kv"])
        for k, _ in pairs:
            held = None if mode == "NX" else self.kind(k)
            if held not in (None, "kv"):
                self.drop([k])
        self.put("kv", keyspace.set_(self.t["kv"], new, self.clock(), mode))

    def _string(self, name: str, *a: str) -> object:
        now = self.clock()
        match name:
            case "GET":
                (key,) = a
                return self._value(key)
            case "SET":
                key, value, *flags = a
                at, mode = None, None
                while flags:
                    f = flags.pop(0).upper()
                    if f in ("EX", "PX"):
                        at = now + timedelta(milliseconds=_int(flags.pop(0)) * (1000 if f == "EX" else 1))
                    elif f in ("NX", "XX"):
                        mode = f
                    else:
                        raise CommandError("ERR syntax error")
                there = self.kind(key) is not None
                if (mode == "NX" and there) or (mode == "XX" and not there):
                    return None
                self._store([(key, value.encode())], at)
                return "OK"
            case "SETEX" | "PSETEX":
                key, span, value = a
                self._store([(key, value.encode())], now + timedelta(milliseconds=_int(span) * (1000 if name == "SETEX" else 1)))
                return "OK"
            case "SETNX":
                key, value = a
                if self.kind(key) is not None:
                    return 0
                self._store([(key, value.encode())])
                return 1
            case "GETSET":
                key, value = a
                old = self._value(key)
                self._store([(key, value.encode())])
                return old
            case "GETDEL":
                (key,) = a
                old = self._value(key)
                if old is not None:
                    self.drop([key])
                return old
            case "GETEX":
                key, *flags = a
                old = self._value(key)
                if old is None or not flags:
                    return old
                f = flags[0].upper()
                if f == "PERSIST":
                    self.put("kv", keyspace.persist(self.t["kv"], self.rows([(key,)], "key string"), now))
                elif f in ("EX", "PX", "EXAT", "PXAT"):
                    self._expire_at(key, self._moment(f, _int(flags[1])))
                else:
                    raise CommandError("ERR syntax error")
                return old
            case "APPEND":
                key, more = a
                self.own("kv", key)
                self.put("kv", keyspace.append(self.t["kv"], self.rows([(key, bytearray(more.encode()))], "key string, value binary"), now))
                return len(self._value(key) or b"")
            case "STRLEN":
                (key,) = a
                return len(self._value(key) or b"")
            case "INCR" | "DECR" | "INCRBY" | "DECRBY":
                key, by = a[0], _int(a[1]) if name.endswith("BY") else 1
                by = -by if name.startswith("DECR") else by
                if not -(2**63) <= by < 2**63:
                    raise CommandError("ERR increment or decrement would overflow")
                self.own("kv", key)
                made = keyspace.incrby(self.t["kv"], self.rows([(key, by)], "key string, delta long"), now)
                out = self._checked(made.select("value"))
                self.put("kv", keyspace.store_text(self.live(), self.rows([(key, out)], "key string, value long")))
                return out
            case "INCRBYFLOAT":
                key, by = a
                self.own("kv", key)
                out = self._checked(keyspace.incrbyfloat(self.t["kv"], self.rows([(key, _float(by))], "key string, delta double"), now).select("value"))
                self.put("kv", keyspace.store_text(self.live(), self.rows([(key, out)], "key string, value string")))
                return out
            case "GETRANGE" | "SUBSTR":
                key, start, stop = a
                got = self.own("kv", key).select(byte_range(F.col("value"), _int(start), _int(stop))).head(1)
                return bytes(got[0][0]) if got else b""
            case "SETRANGE":
                key, offset, value = a
                if self.own("kv", key).isEmpty() and value:
                    self._store([(key, b"")])
                made = keyspace.setrange(self.own("kv", key), _int(offset), value.encode(), now)
                self.put("kv", keyspace.upsert(self.t["kv"], made, "key"))
                return len(self._value(key) or b"")
            case "MGET":
                got = keyspace.mget(self.t["kv"], self.rows(list(enumerate(a)), "pos int, key string"), now).orderBy("pos").collect()
                return [None if r["value"] is None else bytes(r["value"]) for r in got]
            case "MSET" | "MSETNX":
                if len(a) % 2 or not a:
                    raise TypeError
                pairs = list(dict(zip(a[::2], a[1::2], strict=True)).items())
                if name == "MSETNX" and any(self.kind(k) for k, _ in pairs):
                    return 0
                self._store([(k, v.encode()) for k, v in pairs])
                return 1 if name == "MSETNX" else "OK"
        raise CommandError(f"ERR unknown command '{name}'")

    def _checked(self, df: DataFrame) -> object:
        """The one value of a query; an error that it raises becomes the reply's."""
        try:
            return df.head(1)[0][0]
        except Exception as e:
            text = str(e)
            at = text.find("ERR ")
            if at >= 0:
                raise CommandError(text[at:].split("\n")[0].split(" SQLSTATE")[0].strip()) from None
            raise

    def _moment(self, flag: str, n: int) -> datetime:
        if flag in ("EX", "PX"):
            return self.clock() + timedelta(milliseconds=n * (1000 if flag == "EX" else 1))
        return datetime(1970, 1, 1) + timedelta(milliseconds=n * (1000 if flag == "EXAT" else 1))

    def _expire_at(self, key: str, at: datetime) -> int:
        if self.own("kv", key).isEmpty():
            return 0
        self.put("kv", keyspace.expire(self.t["kv"], self.rows([(key, at)], "key string, expire_at timestamp"), self.clock()))
        return 1

    # --- keys

    def _all_keys(self) -> DataFrame:
        out = self.live().select("key")
        for k in KINDS:
            if k != "kv":
                out = out.unionByName(self.t[k].select("key").distinct())
        return out

    def _keyspace(self, name: str, *a: str) -> object:
        match name:
            case "DEL" | "UNLINK":
                return self.drop(list(dict.fromkeys(a)))
            case "EXISTS" | "TOUCH":
                req = self.rows([(k,) for k in a], "key string")
                return req.join(self._all_keys(), "key", "left_semi").count()
            case "EXPIRE" | "PEXPIRE" | "EXPIREAT" | "PEXPIREAT":
                key, n = a
                return self._expire_at(key, self._moment({"EXPIRE": "EX", "PEXPIRE": "PX", "EXPIREAT": "EXAT", "PEXPIREAT": "PXAT"}[name], _int(n)))
            case "PERSIST":
                (key,) = a
                had = not self.own("kv", key).where("expire_at is not null").isEmpty()
                if had:
                    self.put("kv", keyspace.persist(self.t["kv"], self.rows([(key,)], "key string"), self.clock()))
                return int(had)
            case "TTL" | "PTTL":
                (key,) = a
                if self.kind(key) not in (None, "kv"):
                    return -1
                return keyspace.ttl(self.t["kv"], self.rows([(0, key)], "pos int, key string"), self.clock(), name == "PTTL").head(1)[0]["ttl"]
            case "TYPE":
                (key,) = a
                return KINDS.get(self.kind(key) or "", "none")
            case "KEYS":
                (pattern,) = a
                return sorted(r[0] for r in self._all_keys().where(glob(F.col("key"), pattern)).collect())
            case "SCAN":
                cursor, pattern, count = self._scan_args(a)
                page = [r[0] for r in hashes.page(self._all_keys(), "key", cursor, pattern, count + 1).collect()]
                return [str(cursor + count) if len(page) > count else "0", page[:count]]
            case "DBSIZE":
                return self.t["kv"].select("key").unionByName(self._all_keys()).distinct().count()
            case "FLUSHDB" | "FLUSHALL":
                for k in (*KINDS, "stream_groups", "stream_pel"):
                    self.t[k] = self.rows([], SCHEMAS[k])
                return "OK"
            case "RENAME" | "RENAMENX" | "COPY":
                old, new = a[:2]
                held = self.kind(old)
                if held is None:
                    if name == "COPY":
                        return 0
                    raise CommandError("ERR no such key")
                replace = name == "RENAME" or (name == "COPY" and "REPLACE" in [x.upper() for x in a[2:]])
                if not replace and self.kind(new) is not None:
                    return 0
                moved = self.t[held].where(F.col("key") == old).withColumn("key", F.lit(new))
                if new != old:
                    self.drop([new])
                    rest = self.t[held] if name == "COPY" else self.t[held].where(F.col("key") != old)
                    self.put(held, rest.unionByName(moved))
                return "OK" if name == "RENAME" else 1
            case "RANDOMKEY":
                got = self._all_keys().orderBy(F.xxhash64("key"), "key").head(1)
                return got[0][0] if got else None
            case "OBJECT":
                sub, *rest = a
                if sub.upper() == "HELP":
                    return ["OBJECT FREQ|ENCODING|REFCOUNT|IDLETIME key"]
                held = self.kind(rest[0])
                if held is None:
                    return None
                if sub.upper() == "ENCODING":
                    if held == "kv":
                        return keyspace.object_encoding(self.own("kv", rest[0]), self.clock()).head(1)[0]["encoding"]
                    return {"list_items": "linkedlist", "hash_fields": "hashtable", "set_members": "hashtable"}.get(held, "unknown")
                return {"FREQ": 5 + int((self.accesses.count(rest[0]) / 5) ** 0.5), "REFCOUNT": 1, "IDLETIME": 0}[sub.upper()]
            case "DUMP":
                return [[r["key"], bytes(r["value"])] for r in self.live().orderBy("key").collect()]
        raise CommandError(f"ERR unknown command '{name}'")

    @staticmethod
    def _scan_args(a: tuple) -> tuple[int, str, int]:
        cursor, *rest = a
        opts = {rest[i].upper(): rest[i + 1] for i in range(0, len(rest) - 1, 2)}
        return _int(cursor), opts.get("MATCH", "*"), _int(opts.get("COUNT", 10))

    # --- lists

    def _list(self, name: str, *a: str) -> object:
        if name in ("BLPOP", "BRPOP"):
            *keys, _ = a
            got = lists.blocking_pop(self.t["list_items"], self.rows(list(enumerate(keys)), "pos int, key string"), name == "BLPOP").head(1)
            if not got:
                return None
            return [got[0]["key"], self._list(name[1:], got[0]["key"])]
        if name in ("RPOPLPUSH", "LMOVE", "BLMOVE"):
            source, destination = a[:2]
            ends = ("RIGHT", "LEFT") if name == "RPOPLPUSH" else (a[2].upper(), a[3].upper())
            mine = self.own("list_items", source)
            self.own("list_items", destination)
            moved = lists.pop(mine, ends[0] == "LEFT")[0].head(1)
            if not moved:
                return None
            self.put("list_items", lists.lmove(self.t["list_items"], source, destination, ends[0] == "LEFT", ends[1] == "LEFT"))
            return moved[0]["value"]
        key, *rest = a
        mine, others = self.own("list_items", key), self.t["list_items"].where(F.col("key") != key)
        keep = lambda df: self.put("list_items", others.unionByName(df.select("key", "pos", "value")))
        match name:
            case "LPUSH" | "RPUSH":
                if not rest:
                    raise TypeError
                keep(lists.push(mine, self.rows([(key, i, v) for i, v in enumerate(rest)], "key string, ord int, value string"), name == "LPUSH"))
                return self.t["list_items"].where(F.col("key") == key).count()
            case "LPOP" | "RPOP":
                out, left = lists.pop(mine, name == "LPOP")
                got = out.head(1)
                if got:
                    keep(left)
                return got[0]["value"] if got else None
            case "LLEN":
                return mine.count()
            case "LRANGE":
                return [r["value"] for r in lists.lrange(mine, _int(rest[0]), _int(rest[1])).orderBy("idx").collect()]
            case "LINDEX":
                got = lists.lindex(mine, _int(rest[0])).head(1)
                return got[0]["value"] if got else None
            case "LSET":
                if mine.isEmpty():
                    raise CommandError("ERR no such key")
                n, i = mine.count(), _int(rest[0])
                if not -n <= i < n:
                    raise CommandError("ERR index out of range")
                keep(lists.lset(mine, i, F.lit(rest[1])))
                return "OK"
            case "LINSERT":
                where, pivot, value = rest
                if mine.isEmpty():
                    return 0
                if mine.where(F.col("value") == pivot).isEmpty():
                    return -1
                keep(lists.linsert(mine, F.lit(pivot), F.lit(value), where.upper() == "BEFORE"))
                return self.t["list_items"].where(F.col("key") == key).count()
            case "LREM":
                before = mine.count()
                made = lists.lrem(mine, _int(rest[0]), F.lit(rest[1]))
                left = made.count()
                keep(made)
                return before - left
            case "LTRIM":
                keep(lists.ltrim(mine, _int(rest[0]), _int(rest[1])))
                return "OK"
            case "LPOS":
                opts = {rest[i].upper(): _int(rest[i + 1]) for i in range(1, len(rest) - 1, 2)}
                order = F.asc("idx") if opts.get("RANK", 1) > 0 else F.desc("idx")
                got = [r["idx"] for r in lists.lpos(mine, F.lit(rest[0]), opts.get("RANK", 1), opts.get("COUNT", 1), opts.get("MAXLEN", 0)).orderBy(order).collect()]
                return got if "COUNT" in opts else (got[0] if got else None)
        raise CommandError(f"ERR unknown command '{name}'")

    # --- hashes

    def _hash(self, name: str, key: str, *a: str) -> object:
        mine = self.own("hash_fields", key)
        table, fields = self.t["hash_fields"], lambda: self.rows([(key, f) for f in a], "key string, field string")
        match name:
            case "HSET" | "HMSET" | "HSETNX":
                if len(a) % 2 or not a:
                    raise TypeError
                new = self.rows([(key, f, v) for f, v in dict(zip(a[::2], a[1::2], strict=True)).items()], SCHEMAS["hash_fields"])
                added = new.join(mine, "field", "left_anti").count()
                self.put("hash_fields", hashes.hsetnx(table, new) if name == "HSETNX" else hashes.hset(table, new))
                return "OK" if name == "HMSET" else added
            case "HGET":
                got = hashes.hget(table, key, a[0]).head(1)
                return got[0][0] if got else None
            case "HMGET":
                req = self.rows([(i, key, f) for i, f in enumerate(a)], "pos int, key string, field string")
                return [r["value"] for r in hashes.hmget(table, req).orderBy("pos").collect()]
            case "HDEL":
                n = mine.where(F.col("field").isin(list(a))).count()
                self.put("hash_fields", hashes.hdel(table, fields()))
                return n
            case "HGETALL":
                return {r["field"]: r["value"] for r in mine.orderBy("field").collect()}
            case "HKEYS" | "HVALS":
                return [r["field" if name == "HKEYS" else "value"] for r in mine.orderBy("field").collect()]
            case "HLEN":
                return mine.count()
            case "HEXISTS":
                return int(not mine.where(F.col("field") == a[0]).isEmpty())
            case "HINCRBY" | "HINCRBYFLOAT":
                made = hashes.hincrby(mine, self.rows([(key, a[0], _int(a[1]))], "key string, field string, delta long")) if name == "HINCRBY" else hashes.hincrbyfloat(mine, self.rows([(key, a[0], _float(a[1]))], "key string, field string, delta double"))
                out = self._checked(made.select("value"))
                self.put("hash_fields", hashes.hset(table, self.rows([(key, a[0], str(out))], SCHEMAS["hash_fields"])))
                return out
            case "HRANDFIELD":
                got = hashes.random_fields(mine, key, _int(a[0]) if a else 1, int(time.time())).collect()
                if not a:
                    return got[0]["field"] if got else None
                return [x for r in got for x in ((r["field"], r["value"]) if len(a) > 1 else (r["field"],))]
            case "HSCAN":
                cursor, pattern, count = self._scan_args(a)
                page = hashes.page(mine, "field", cursor, pattern, count + 1).collect()
                return [str(cursor + count) if len(page) > count else "0", [x for r in page[:count] for x in (r["field"], r["value"])]]
        raise CommandError(f"ERR unknown command '{name}'")

    # --- sets

    def _set(self, name: str, *a: str) -> object:
        table = self.t["set_members"]
        members = lambda df: sorted(r["member"] for r in df.collect())
        if name in ("SUNION", "SINTER", "SDIFF"):
            for k in a:
                self.own("set_members", k)
            return members({"SUNION": sets.sunion, "SINTER": sets.sinter, "SDIFF": sets.sdiff}[name](table, list(a)))
        if name in ("SUNIONSTORE", "SINTERSTORE", "SDIFFSTORE"):
            destination, *keys = a
            for k in keys:
                self.own("set_members", k)
            out = {"SUNIONSTORE": sets.sunion, "SINTERSTORE": sets.sinter, "SDIFFSTORE": sets.sdiff}[name](table, keys)
            n = out.count()
            if self.kind(destination) not in (None, "set_members"):
                self.drop([destination])
            self.put("set_members", sets.store(table, destination, out))
            return n
        if name == "SINTERCARD":
            n = _int(a[0])
            limit = _int(a[n + 2]) if len(a) > n + 1 else 0
            return sets.sintercard(table, list(a[1 : n + 1]), limit).head(1)[0]["n"]
        if name == "SMOVE":
            source, destination, member = a
            if self.own("set_members", source).where(F.col("member") == member).isEmpty():
                return 0
            self.own("set_members", destination)
            self.put("set_members", sets.smove(table, source, destination, member))
            return 1
        key, *rest = a
        mine = self.own("set_members", key)
        given = lambda: self.rows([(key, m) for m in rest], SCHEMAS["set_members"])
        match name:
            case "SADD":
                n = given().distinct().join(mine, "member", "left_anti").count()
                self.put("set_members", sets.sadd(table, given()))
                return n
            case "SREM":
                n = mine.where(F.col("member").isin(rest)).count()
                self.put("set_members", sets.srem(table, given()))
                return n
            case "SMEMBERS":
                return members(mine)
            case "SISMEMBER":
                return int(not mine.where(F.col("member") == rest[0]).isEmpty())
            case "SMISMEMBER":
                req = self.rows([(i, key, m) for i, m in enumerate(rest)], "pos int, key string, member string")
                return [r["present"] for r in sets.smismember(table, req).orderBy("pos").collect()]
            case "SCARD":
                return mine.count()
            case "SPOP" | "SRANDMEMBER":
                count, seed = _int(rest[0]) if rest else 1, int(time.time() * 1000)
                got = [r["member"] for r in sets.random_members(table, key, count, seed).collect()]
                if name == "SPOP" and got:
                    self.put("set_members", table.where(~((F.col("key") == key) & F.col("member").isin(got))))
                return got if rest else (got[0] if got else None)
            case "SSCAN":
                cursor, pattern, count = self._scan_args(tuple(rest))
                page = [r["member"] for r in hashes.page(mine, "member", cursor, pattern, count + 1).collect()]
                return [str(cursor + count) if len(page) > count else "0", page[:count]]
        raise CommandError(f"ERR unknown command '{name}'")

    # --- sorted sets

    def _zset(self, name: str, *a: str) -> object:
        if name in ("BZPOPMIN", "BZPOPMAX"):
            *keys, _ = a
            got = zsets.blocking_zpop(self.t["zset"], self.rows(list(enumerate(keys)), "pos int, key string"), name == "BZPOPMAX").head(1)
            if not got:
                return None
            return [got[0]["key"], self._zset(name[1:], got[0]["key"])]
        key, *rest = a
        mine, table, reverse = self.own("zset", key), self.t["zset"], "REV" in name
        order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]

        def reply(df: DataFrame, scores: bool) -> list:
            return [x for r in df.orderBy(*order).collect() for x in ((r["member"], _number_text(r["score"])) if scores else (r["member"],))]

        def page(args: list[str]) -> dict:
            up = [x.upper() for x in args]
            at = up.index("LIMIT") if "LIMIT" in up else None
            return {} if at is None else {"offset": _int(args[at + 1]), "count": _int(args[at + 2])}

        scores = any(x.upper() == "WITHSCORES" for x in rest)
        match name:
            case "ZADD":
                if len(rest) % 2 or not rest:
                    raise TypeError
                new = self.rows([(key, m, _float(s)) for m, s in {rest[i + 1]: rest[i] for i in range(0, len(rest), 2)}.items()], SCHEMAS["zset"])
                n = new.join(mine, "member", "left_anti").count()
                self.put("zset", zsets.zadd(table, new))
                return n
            case "ZREM":
                n = mine.where(F.col("member").isin(rest)).count()
                self.put("zset", zsets.zrem(table, self.rows([(key, m) for m in rest], "key string, member string")))
                return n
            case "ZSCORE" | "ZMSCORE":
                req = self.rows([(i, key, m) for i, m in enumerate(rest)], "pos int, key string, member string")
                got = [None if r["score"] is None else _number_text(r["score"]) for r in zsets.zmscore(table, req).orderBy("pos").collect()]
                return got if name == "ZMSCORE" else got[0]
            case "ZINCRBY":
                out = zsets.zincrby(mine, self.rows([(key, rest[1], _float(rest[0]))], "key string, member string, delta double")).head(1)[0]["score"]
                self.put("zset", zsets.zadd(table, self.rows([(key, rest[1], out)], SCHEMAS["zset"])))
                return _number_text(out)
            case "ZCARD":
                return mine.count()
            case "ZRANK" | "ZREVRANK":
                got = zsets.zrank(mine, self.rows([(key, rest[0])], "key string, member string"), reverse).head(1)
                return got[0]["rank"] if got else None
            case "ZRANGE" | "ZREVRANGE":
                return reply(zsets.zrange(mine, _int(rest[0]), _int(rest[1]), reverse), scores)
            case "ZRANGEBYSCORE" | "ZREVRANGEBYSCORE":
                lo, hi = (rest[1], rest[0]) if reverse else (rest[0], rest[1])
                return reply(zsets.zrangebyscore(mine, lo, hi, key=key, reverse=reverse, **page(rest[2:])), scores)
            case "ZRANGEBYLEX" | "ZREVRANGEBYLEX":
                lo, hi = (rest[1], rest[0]) if reverse else (rest[0], rest[1])
                return reply(zsets.zrangebylex(mine, lo, hi, key=key, reverse=reverse, **page(rest[2:])), False)
            case "ZCOUNT" | "ZLEXCOUNT":
                got = (zsets.zcount if name == "ZCOUNT" else zsets.zlexcount)(mine, rest[0], rest[1]).head(1)
                return got[0]["n"] if got else 0
            case "ZPOPMIN" | "ZPOPMAX":
                count = _int(rest[0]) if rest else 1
                order = [F.desc("score"), F.desc("member")] if name == "ZPOPMAX" else order
                out, left = zsets.zpop(mine, count, name == "ZPOPMAX")
                got = reply(out, True)
                self.put("zset", table.where(F.col("key") != key).unionByName(left))
                return got
            case "ZRANDMEMBER":
                got = zsets.random_members(mine, key, _int(rest[0]) if rest else 1, int(time.time() * 1000)).collect()
                if not rest:
                    return got[0]["member"] if got else None
                return [x for r in got for x in ((r["member"], _number_text(r["score"])) if scores else (r["member"],))]
            case "ZSCAN":
                cursor, pattern, count = self._scan_args(tuple(rest))
                got = hashes.page(mine, "member", cursor, pattern, count + 1).collect()
                return [str(cursor + count) if len(got) > count else "0", [x for r in got[:count] for x in (r["member"], _number_text(r["score"]))]]
        raise CommandError(f"ERR unknown command '{name}'")

    # --- streams

    @staticmethod
    def _entries(df: DataFrame, reverse: bool = False) -> list:
        got = df.orderBy(*([F.desc("ms"), F.desc("seq")] if reverse else ["ms", "seq"])).collect()
        return [[f"{r['ms']}-{r['seq']}", [x for f in r["fields"] or [] for x in (f["k"], f["v"])]] for r in got]

    def _ids(self, ids: list[str], **more: str) -> DataFrame:
        cols = list(more)
        data = [(*more.values(), *streams.parse_id(i, streams.MIN_ID)) for i in ids]
        return self.rows(data, ", ".join([f"`{c}` string" for c in cols] + ["ms long", "seq long"]))

    def _stream(self, name: str, *a: str) -> object:
        e, groups, pel, now = self.t["stream_entries"], self.t["stream_groups"], self.t["stream_pel"], self.now_ms()
        if name in ("XREAD", "XREADGROUP"):
            words, group, consumer, count = list(a), None, None, None
            while words[0].upper() != "STREAMS":
                w = words.pop(0).upper()
                if w == "GROUP":
                    group, consumer = words.pop(0), words.pop(0)
                elif w == "COUNT":
                    count = _int(words.pop(0))
                elif w == "BLOCK" and name == "XREADGROUP":
                    words.pop(0)
                else:
                    raise CommandError("ERR syntax error")
            keys, ids = words[1 : 1 + (len(words) - 1) // 2], words[1 + (len(words) - 1) // 2 :]
            out = []
            for k, i in zip(keys, ids, strict=True):
                if name == "XREAD":
                    ms, dash, seq = i.partition("-")
                    if not (ms.isdigit() and (not dash or seq.isdigit())):
                        continue
                    got = self._entries(streams.xread(self.own("stream_entries", k), self.rows([(k, int(ms), int(seq or 0))], "key string, after_ms long, after_seq long"), count))
                elif i == ">":
                    if groups.where((F.col("key") == k) & (F.col("group") == group)).isEmpty():
                        groups = groups.unionByName(self.rows([(k, group, 0, 0)], SCHEMAS["stream_groups"]))
                    new = streams.read_new(self.own("stream_entries", k), groups.where(F.col("key") == k), group, count)
                    got = self._entries(new)
                    groups, pel = streams.deliver(groups, pel, new.select("key", "ms", "seq"), group, consumer, now)
                else:
                    got = self._entries(streams.replay(self.own("stream_entries", k), pel.where(F.col("key") == k), group, consumer))
                if got:
                    out.append([k, got])
            if name == "XREADGROUP":
                self.put("stream_groups", groups)
                self.put("stream_pel", pel)
            return out or None
        if name == "XGROUP":
            sub, key, group, *rest = a
            match sub.upper():
                case "CREATE":
                    self.put("stream_groups", streams.group_create(groups, e, key, group, rest[0], "MKSTREAM" in [x.upper() for x in rest]))
                    return "OK"
                case "DESTROY":
                    had = not groups.where((F.col("key") == key) & (F.col("group") == group)).isEmpty()
                    g, p = streams.group_destroy(groups, pel, key, group)
                    self.put("stream_groups", g)
                    self.put("stream_pel", p)
                    return int(had)
                case "DELCONSUMER":
                    n = pel.where((F.col("key") == key) & (F.col("group") == group) & (F.col("consumer") == rest[0])).count()
                    self.put("stream_pel", streams.del_consumer(pel, key, group, rest[0]))
                    return n
            raise CommandError("ERR syntax error")
        if name == "XINFO":
            sub, key = a
            if sub.upper() == "GROUPS":
                return [r.asDict() for r in streams.xinfo_groups(groups.where(F.col("key") == key), pel).orderBy("group").collect()]
            got = streams.xinfo_stream(self.own("stream_entries", key), groups).head(1)
            if not got:
                raise CommandError("ERR no such key")
            return got[0].asDict()
        key, *rest = a
        mine, others = self.own("stream_entries", key), e.where(F.col("key") != key)
        match name:
            case "XADD":
                maxlen = None
                if rest[0].upper() == "MAXLEN":
                    maxlen, rest = _int(rest[1]), rest[2:]
                entry, *pairs = rest
                if len(pairs) % 2 or not pairs:
                    raise TypeError
                fields = [(pairs[i], pairs[i + 1]) for i in range(0, len(pairs), 2)]
                if entry == "*":
                    new = streams.auto_ids(self.rows([(key, 0, fields)], "key string, ord int, fields array<struct<k:string,v:string>>"), mine, now)
                else:
                    at = streams.parse_id(entry, (-1, -1))
                    if at == (-1, -1):
                        raise CommandError("ERR Invalid stream ID specified as stream command argument")
                    new = self.rows([(key, *at, fields)], SCHEMAS["stream_entries"])
                made = streams.xadd(mine, new, maxlen)
                top = self._checked(made.agg(F.max(F.struct("ms", "seq"))))
                self.put("stream_entries", others.unionByName(made))
                return f"{top['ms']}-{top['seq']}"
            case "XLEN":
                return mine.count()
            case "XRANGE" | "XREVRANGE":
                reverse = name == "XREVRANGE"
                start, end = (rest[1], rest[0]) if reverse else (rest[0], rest[1])
                return self._entries(streams.xrange(mine, start, end, _int(rest[3]) if len(rest) > 3 else None, reverse), reverse)
            case "XTRIM":
                got = streams.xtrimmed(mine, _int(rest[1])).head(1)
                self.put("stream_entries", others.unionByName(streams.xtrim(mine, _int(rest[1]))))
                return got[0]["removed"] if got else 0
            case "XDEL":
                gone = self._ids(rest, key=key)
                n = mine.join(gone, ["key", "ms", "seq"], "left_semi").count()
                self.put("stream_entries", streams.xdel(e, gone))
                return n
            case "XACK":
                done = self._ids(rest[1:], key=key, group=rest[0])
                n = pel.join(done, ["key", "group", "ms", "seq"], "left_semi").count()
                self.put("stream_pel", streams.xack(pel, done))
                return n
            case "XPENDING":
                group, *more = rest
                if groups.where((F.col("key") == key) & (F.col("group") == group)).isEmpty():
                    raise CommandError(f"NOGROUP No such key '{key}' or consumer group '{group}'")
                own = pel.where((F.col("key") == key) & (F.col("group") == group))
                if more:
                    return [[r["id"], r["consumer"], r["idle"], r["deliveries"]] for r in streams.xpending_detail(own, more[0], more[1], _int(more[2]), now).collect()]
                got = streams.xpending(own).orderBy("consumer").collect()
                ends = own.agg(F.min(F.struct("ms", "seq")).alias("a"), F.max(F.struct("ms", "seq")).alias("b")).head(1)[0]
                ident = lambda x: None if x is None else f"{x['ms']}-{x['seq']}"
                return [sum(r["pending"] for r in got), ident(ends["a"]), ident(ends["b"]), [[r["consumer"], str(r["pending"])] for r in got]]
            case "XCLAIM" | "XAUTOCLAIM":
                group, consumer, idle, *ids = rest
                if name == "XCLAIM":
                    wanted = self._ids(ids, key=key, group=group)
                    wanted = wanted.join(pel.where(now - F.col("delivered_ms") >= _int(idle)), ["key", "group", "ms", "seq"], "left_semi")
                else:
                    wanted = streams.autoclaim_candidates(pel, key, group, _int(idle), ids[0], now, _int(ids[2]) if len(ids) > 2 else 100)
                taken = self.rows([tuple(r) for r in wanted.select("key", "group", "ms", "seq").collect()], "key string, `group` string, ms long, seq long")
                got = self._entries(mine.join(taken.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_semi"))
                cursor = streams.autoclaim_cursor(taken).head(1)[0]["next"]
                self.put("stream_pel", streams.xclaim(pel, taken, consumer, _int(idle), now))
                return got if name == "XCLAIM" else [cursor, got, []]
        raise CommandError(f"ERR unknown command '{name}'")

    # --- sketches, bitmaps, positions, vectors

    def _hyperloglog(self, name: str, *a: str) -> object:
        s = self.t["sketches"]
        if name == "PFCOUNT":
            return sketches.pfcount(s, list(a)).head(1)[0]["n"]
        key, *rest = a
        before = sketches.pfcount(s, [key]).head(1)[0]["n"]
        if name == "PFADD":
            made = sketches.pfadd(s, self.rows([(key, x) for x in rest], "key string, element string")) if rest else s
        else:
            made = sketches.pfmerge(s, key, rest)
        self.put("sketches", made)
        return "OK" if name == "PFMERGE" else int(sketches.pfcount(made, [key]).head(1)[0]["n"] != before)

    def _bitmap(self, name: str, *a: str) -> object:
        if name == "BITOP":
            op, destination, *keys = a
            parts = self.live().where(F.col("key").isin(keys))
            size = parts.agg(F.max(F.octet_length("value"))).head(1)[0][0] or 0
            if op.upper() == "NOT" and len(keys) == 1:
                inverted = bytes(255 ^ b for b in self._value(keys[0]) or b"")
                self._store([(destination, inverted)])
                return len(inverted)
            made = {r["byte"]: r["bits"] for r in bitmaps.bitop(bitmaps.from_binary(parts.select("key", "value")), op, destination, keys).collect()}
            self._store([(destination, bytes(made.get(i, 0) for i in range(size)))])
            return size
        key, *rest = a
        value = self._value(key) or b""
        one = self.rows([(key, bytearray(value))], "key string, value binary")
        bm = bitmaps.from_binary(one)
        field = lambda f, c: one.select(c(F.col("value"), f)).head(1)[0][0]

        def change(f: bitmaps.Field, new: int) -> None:
            nonlocal value, one
            value = bytes(one.select(bitmaps.field_set(F.col("value"), f, F.lit(new).cast("bigint"))).head(1)[0][0])
            one = self.rows([(key, bytearray(value))], "key string, value binary")

        match name:
            case "GETBIT" | "SETBIT":
                f = bitmaps.Field(False, 1, _int(rest[0]))
                old = field(f, bitmaps.field_get)
                if name == "SETBIT":
                    if rest[1] not in ("0", "1"):
                        raise CommandError("ERR bit is not an integer or out of range")
                    change(f, int(rest[1]))
                    self._store([(key, value)])
                return old
            case "BITCOUNT":
                if not rest:
                    got = bitmaps.bitcount(bm).head(1)
                else:
                    bits = len(rest) > 2 and rest[2].upper() == "BIT"
                    n = len(value) * (8 if bits else 1)
                    start, end = (max(n + i, 0) if i < 0 else i for i in (_int(rest[0]), _int(rest[1])))
                    got = bitmaps.bitcount(bm, start, min(end, n - 1), bits).head(1) if start <= min(end, n - 1) else []
                return (got[0]["n"] or 0) if got else 0
            case "BITPOS":
                bit, start = _int(rest[0]), _int(rest[1]) if len(rest) > 1 else 0
                if not value:
                    return -1 if bit else 0
                start = max(len(value) + start, 0) if start < 0 else start
                if len(rest) > 2:
                    bits = len(rest) > 3 and rest[3].upper() == "BIT"
                    n = len(value) * (8 if bits else 1)
                    a0, b0 = (max(n + i, 0) if i < 0 else i for i in (_int(rest[1]), _int(rest[2])))
                    span = range(a0, b0 + 1) if bits else range(a0 * 8, (b0 + 1) * 8)
                    return next((i for i in span if i < len(value) * 8 and value[i >> 3] >> (7 - (i & 7)) & 1 == bit), -1)
                return bitmaps.bitpos(bm, self.rows([(key, len(value))], "key string, n long"), bit, start).head(1)[0]["pos"]
            case "BITFIELD":
                out, overflow, words, wrote = [], "WRAP", list(rest), False
                while words:
                    op = words.pop(0).upper()
                    if op == "OVERFLOW":
                        overflow = words.pop(0).upper()
                        continue
                    f = bitmaps.Field.parse(words.pop(0), words.pop(0))
                    if op == "GET":
                        out.append(field(f, bitmaps.field_get))
                    elif op == "SET":
                        out.append(field(f, bitmaps.field_get))
                        change(f, _int(words.pop(0)))
                        wrote = True
                    elif op == "INCRBY":
                        by = _int(words.pop(0))
                        got = one.select(bitmaps.field_incr(F.col("value"), f, by, overflow)).head(1)[0][0]
                        out.append(got)
                        if got is not None:
                            change(f, got)
                            wrote = True
                    else:
                        raise CommandError("ERR syntax error")
                if wrote:
                    self._store([(key, value)])
                return out
        raise CommandError(f"ERR unknown command '{name}'")

    def _geo(self, name: str, key: str, *a: str) -> object:
        mine, table = self.own("geo", key), self.t["geo"]
        match name:
            case "GEOADD":
                words, mode, changed = list(a), None, False
                while words and words[0].upper() in ("NX", "XX", "CH"):
                    w = words.pop(0).upper()
                    mode, changed = (mode, True) if w == "CH" else (w, changed)
                new = self.rows([(key, words[i + 2], _float(words[i]), _float(words[i + 1])) for i in range(0, len(words), 3)], SCHEMAS["geo"])
                made = geo.geoadd(mine, new, mode)
                self._checked(made.agg(F.sum("lon")))
                old = {r["member"]: (r["lon"], r["lat"]) for r in mine.join(new, "member", "left_semi").collect()}
                after = {r["member"]: (r["lon"], r["lat"]) for r in made.join(new, "member", "left_semi").collect()}
                self.put("geo", table.where(F.col("key") != key).unionByName(made))
                return sum(m not in old or (changed and old[m] != p) for m, p in after.items())
            case "GEODIST":
                got = geo.geodist(mine, self.rows([(key, a[0], a[1])], "key string, a string, b string"), a[2] if len(a) > 2 else "m").head(1)
                return None if got[0]["dist"] is None else f"{got[0]['dist']:.4f}"
            case "GEOPOS" | "GEOHASH":
                req = self.rows([(i, key, m) for i, m in enumerate(a)], "pos int, key string, member string")
                if name == "GEOPOS":
                    return [None if r["lon"] is None else [f"{r['lon']:.6f}", f"{r['lat']:.6f}"] for r in geo.geopos(mine, req).orderBy("pos").collect()]
                got = req.join(mine, ["key", "member"], "left").select("pos", geo.geohash(F.col("lon"), F.col("lat")).alias("h")).orderBy("pos").collect()
                return [r["h"] for r in got]
            case "GEOSEARCH":
                words, opts, at, member = list(a), {}, None, None
                radius, unit = 0.0, "m"
                while words:
                    w = words.pop(0).upper()
                    if w == "FROMMEMBER":
                        member = words.pop(0)
                    elif w == "FROMLONLAT":
                        at = (_float(words.pop(0)), _float(words.pop(0)))
                    elif w == "BYRADIUS":
                        radius, unit = _float(words.pop(0)), words.pop(0)
                    elif w == "COUNT":
                        opts["count"] = _int(words.pop(0))
                    elif w in ("ASC", "DESC"):
                        opts["descending"] = w == "DESC"
                    elif w.startswith("WITH"):
                        opts.setdefault("with", []).append(w)
                    else:
                        raise CommandError("ERR syntax error")
                extra = opts.pop("with", [])
                df = geo.geosearch_member(mine, key, member, radius, unit, **opts) if member is not None else geo.geosearch(mine, *at, radius, unit, key=key, **opts)
                out = []
                for r in df.collect():
                    more = [f"{r['dist']:.4f}"] * ("WITHDIST" in extra) + [r["hash"]] * ("WITHHASH" in extra) + [[f"{r['lon']:.6f}", f"{r['lat']:.6f}"]] * ("WITHCOORD" in extra)
                    out.append([r["member"], *more] if extra else r["member"])
                return out
        raise CommandError(f"ERR unknown command '{name}'")

    def _vector(self, name: str, key: str, *a: str) -> object:
        table = self.t["vectors"]
        match name:
            case "VECSET":
                vec = [_float(x) for x in a[1:]]
                if len(vec) != _int(a[0]):
                    raise CommandError("ERR vector dimension mismatch")
                made = vectors.vecset(table, self.rows([(key, vec)], "index string, vec array<float>"))
                self._checked(made.agg(F.max("id")))
                self.put("vectors", made)
                return self.rows([(vec,)], "vec array<float>").select(F.xxhash64("vec")).head(1)[0][0]
            case "VECQUERY":
                got = vectors.knn(table, [_float(x) for x in a[1:]], _int(a[0]), index=key).collect()
                return [[r["id"], float(r["distance"])] for r in got]
            case "VECDEL":
                had = not table.where(F.col("index") == key).isEmpty()
                self.put("vectors", vectors.vecdel(table, key))
                return int(had)
        raise CommandError(f"ERR unknown command '{name}'")

    # --- documents

    def _document(self, name: str, c: str, *a: str) -> object:
        if name == "DOC.CREATE":
            profile = a[1].lower() if len(a) > 1 and a[0].upper() == "COMPRESSION" else "balanced"
            if c in self.collections:
                raise CommandError("ERR collection already exists")
            if profile not in ("none", "dictionary", "balanced", "compact"):
                raise CommandError("ERR unknown compression profile")
            self.collections[c] = self.rows([], "doc_seq long, doc_id string, json string").select("doc_seq", "doc_id", F.parse_json("json").alias("body"))
            self.created[c] = (time.time(), profile)
            return "OK"
        if name == "DOC.DROP":
            return int(self.collections.pop(c, None) is not None)
        if c not in self.collections:
            raise CommandError("ERR unknown collection")
        d, index = self.collections[c], self.t["indexes"]

        def store(df: DataFrame) -> None:
            for r in index.where((F.col("collection") == c) & (F.col("kind") == "unique")).collect():
                if not docs.unique_violations(df, r["path"]).isEmpty():
                    raise CommandError("ERR unique constraint violation")
            # rows of the writes so far, kept as text: a variant column can't be checkpointed everywhere
            self.collections[c] = df

        def paths() -> list[str]:
            kinds = d.agg(F.schema_of_variant_agg("body")).head(1)[0][0]
            return _leaf_paths(kinds)

        one = lambda r: json.loads(r["json"])
        match name:
            case "DOC.SET":
                self._checked(self.rows([(a[1],)], "j string").select(docs.checked_body(F.col("j")).isNotNull()))
                store(docs.set_(d, self.rows([(a[0], a[1])], "doc_id string, json string")))
                return "OK"
            case "DOC.MSET":
                pairs = [(i, a[i], a[i + 1]) for i in range(0, len(a), 2)]
                new = self.rows(pairs, "pos int, doc_id string, json string")
                self._checked(new.select(F.max(docs.checked_body(F.col("json")).isNotNull())))
                store(docs.set_(d, new))
                return "OK"
            case "DOC.INSERT":
                self._checked(self.rows([(a[0],)], "j string").select(docs.checked_body(F.col("j")).isNotNull()))
                made = docs.insert(d, self.rows([(0, a[0])], "ord int, json string"))
                store(made)
                return made.orderBy(F.desc("doc_seq")).head(1)[0]["doc_id"]
            case "DOC.GET" | "DOC.MGET":
                ids = [a[0]] if name == "DOC.GET" else list(a)
                got = [None if r["json"] is None else one(r) for r in docs.get(d, self.rows(list(enumerate(ids)), "pos int, doc_id string")).orderBy("pos").collect()]
                if name == "DOC.MGET":
                    return got
                return project(got[0], list(a[2:])) if got[0] is not None and len(a) > 1 else got[0]
            case "DOC.UPDATE":
                here = F.col("doc_id") == a[0]
                if d.where(here).isEmpty():
                    return 0
                ops = parse_mutations(list(a[1:]))
                body = json.loads(d.where(here).select(F.to_json("body").alias("json")).head(1)[0]["json"])
                store(docs.set_(d, self.rows([(a[0], json.dumps(docs.mutate(body, ops)))], "doc_id string, json string")))
                return 1
            case "DOC.DEL":
                n = d.where(F.col("doc_id") == a[0]).count()
                self.collections[c] = docs.delete(d, self.rows([(a[0],)], "doc_id string"))
                return n
            case "DOC.EXISTS":
                return int(not d.where(F.col("doc_id") == a[0]).isEmpty())
            case "DOC.CREATEINDEX":
                self.put("indexes", docs.create_index(index, d, c, a[0], a[1].lower()))
                return "OK"
            case "DOC.DROPINDEX":
                self.put("indexes", docs.drop_index(index, c, a[0]))
                return "OK"
            case "DOC.INDEXES":
                return [[r["path"], r["kind"]] for r in index.where(F.col("collection") == c).orderBy("path").collect()]
            case "DOC.FIND":
                q = parse_find(list(a))
                got = docs.find_variant(d, type(q)(q.where, q.order_by, q.descending, None, q.limit, q.offset))
                found = got.select("doc_seq", F.to_json("body").alias("json"))
                rows = (found if q.order_by else found.orderBy("doc_seq")).collect()
                return [project(one(r), list(q.project)) if q.project else one(r) for r in rows]
            case "DOC.COUNT":
                if not a or a[0].upper() != "WHERE":
                    raise CommandError("WHERE is missing")
                return docs.count_variant(d, " ".join(a[1:])).head(1)[0]["n"]
            case "DOC.INFO":
                info = docs.dictionary_info(d, paths()) if not d.isEmpty() else None
                at, profile = self.created[c]
                return {"created_at": int(at), "compression": profile, "doc_count": d.count(), "dictionary_entries": (info.agg(F.sum("cardinality")).head(1)[0][0] or 0) if info is not None else 0}
            case "DOC.DICTINFO":
                return {r["path"]: r["cardinality"] for r in docs.dictionary_info(d, paths()).orderBy("path").collect()} if not d.isEmpty() else {}
            case "DOC.STORAGE":
                return docs.storage_info(d).head(1)[0].asDict()
        raise CommandError(f"ERR unknown command '{name}'")

    # --- messages, change log, statistics

    def _pubsub(self, name: str, *a: str) -> object:
        s = self.t["subscriptions"]
        kind = "glob" if name.startswith("P") and name != "PUBLISH" else "exact"
        match name:
            case "SUBSCRIBE" | "PSUBSCRIBE":
                self.put("subscriptions", pubsub.subscribe(s, self.rows([("self", kind, p) for p in a], SCHEMAS["subscriptions"])))
                return self.t["subscriptions"].count()
            case "UNSUBSCRIBE" | "PUNSUBSCRIBE":
                self.put("subscriptions", pubsub.unsubscribe(s, "self", list(a) or None, kind))
                return self.t["subscriptions"].count()
            case "PUBLISH":
                channel, message = a
                return pubsub.publish_counts(self.rows([(channel, message)], "channel string, message string"), s).head(1)[0]["receivers"]
        raise CommandError(f"ERR unknown command '{name}'")

    def record(self, before: DataFrame, after: DataFrame) -> int:
        """Adds the changes between two kv tables to the change log; how many they are."""
        made = cdc.changes(before, after, self.seq, self.now_ms())
        n = made.count()
        self.seq += n
        self.put("cdc", self.t["cdc"].unionByName(made))
        return n

    def _cdc(self, name: str, *a: str) -> object:
        log, groups, pel, now = self.t["cdc"], self.t["cdc_groups"], self.t["cdc_pel"], self.now_ms()
        event = lambda r: [r["seq"], r["ts_ms"], r["op"], r["key"], r["value"]]
        if name == "CDCPOLL":
            cursor, count = _int(a[0]), _int(a[1])
            status = cdc.poll_status(log, cursor, count).head(1)[0]
            return [status["next"], [event(r) for r in cdc.poll(log, cursor, count).collect()], status["gap"]]
        if name == "CDC.GROUP":
            sub, _, group, *rest = a
            if sub.upper() == "CREATE":
                self.put("cdc_groups", cdc.group_create(groups, group, _int(rest[0])))
                return "OK"
            if groups.where(F.col("group") == group).isEmpty():
                raise CommandError("NOGROUP no such group")
            page = cdc.group_read(log, groups, pel, group, rest[0], _int(rest[1]), now).orderBy(F.desc("redelivered"), "seq").collect()
            given = self.rows([(r["seq"], r["redelivered"]) for r in page], "seq long, redelivered boolean")
            g, p = cdc.group_deliver(groups, pel, given, group, rest[0], now)
            self.put("cdc_groups", g)
            self.put("cdc_pel", p)
            return [event(r) for r in page]
        if name == "CDC.ACK":
            _, group, *seqs = a
            done = self.rows([(group, _int(s)) for s in seqs], "`group` string, seq long")
            n = pel.join(done, ["group", "seq"], "left_semi").count()
            self.put("cdc_pel", cdc.ack(pel, done))
            return n
        return [[r["seq"], r["consumer"], r["idle"], r["deliveries"]] for r in cdc.pending(pel, a[1], now).collect()]

    def _stats(self, name: str, *a: str) -> object:
        if name == "STATS.MEMORY":
            sizes = self.live().select("key", (F.octet_length("key") + F.octet_length("value")).alias("bytes"))
            return [[r["prefix"], r["bytes"]] for r in stats.memory(sizes, list(a)).collect()]
        if name == "STATS.HOTKEYS":
            return [[r["key"], r["n"]] for r in stats.hot_keys(self.rows([(k,) for k in self.accesses], "key string"), _int(a[0])).collect()]
        ps = [_float(p) for p in a[1:]]
        mine = [s for s in self.samples if s[0] == a[0].lower()]
        got = stats.latency(self.rows(mine, "command string, duration double"), ps).first() if mine and ps else None
        return {f"p{p}": float(got[i + 1]) if got else 0.0 for i, p in enumerate(a[1:])}

    # --- transactions and the server

    def _transaction(self, name: str, *a: str) -> object:
        match name:
            case "MULTI":
                if self.queue is not None:
                    raise CommandError("ERR MULTI calls can not be nested")
                self.queue = []
                return "OK"
            case "EXEC" | "DISCARD":
                if self.queue is None:
                    raise CommandError(f"ERR {name} without MULTI")
                todo, self.queue = self.queue, None
                if name == "DISCARD":
                    return "OK"
                out = []
                for args in todo:
                    try:
                        out.append(self.execute(*args))
                    except CommandError as e:
                        out.append(e)
                return out
            case "WATCH" | "UNWATCH":  # accepted and not enforced
                return "OK"
        raise CommandError(f"ERR unknown command '{name}'")

    def _server(self, name: str, *a: str) -> object:
        match name:
            case "PING":
                return a[0] if a else "PONG"
            case "ECHO":
                return a[0]
            case "TIME":
                ms = self.now_ms()
                return [str(ms // 1000), str(ms % 1000 * 1000)]
            case "COMMAND":
                sub = a[0].upper() if a else "INFO"
                table = commands.table(self.spark)
                if sub == "COUNT":
                    return table.count()
                if sub == "LIST":
                    return [r["name"] for r in table.orderBy("name").collect()]
                if sub == "HELP":
                    return ["COMMAND COUNT|LIST|INFO|DOCS"]
                wanted = [x.upper() for x in a[1:]]
                return [[r["name"], r["family"]] for r in (table.where(F.col("name").isin(wanted)) if wanted else table).orderBy("name").collect()]
            case "CONFIG":
                sub = a[0].upper()
                if sub == "GET":
                    import fnmatch

                    return {k: v for k, v in self.config.items() if fnmatch.fnmatchcase(k, a[1])}
                if sub == "SET":
                    if a[1] not in self.config:
                        raise CommandError(f"ERR Unknown option or number of arguments for CONFIG SET - '{a[1]}'")
                    self.config[a[1]] = a[2]
                return "OK"
            case "CLIENT":
                sub = a[0].upper()
                if sub == "SETNAME":
                    self.config["client"] = a[1]
                    return "OK"
                return {"ID": 1, "GETNAME": self.config.get("client"), "LIST": "id=1", "INFO": "id=1"}[sub]
            case "INFO":
                return f"spark_version:{self.spark.version}\r\ntables:{len(self.t)}\r\ncollections:{len(self.collections)}\r\n"
            case "HELLO":
                if a and a[0] not in ("2", "3"):
                    raise CommandError("NOPROTO unsupported protocol version")
                return {"server": "tessera", "proto": int(a[0]) if a else 2}
            case "AUTH":
                if a[-1] != self.config["requirepass"]:
                    raise CommandError("WRONGPASS invalid username-password pair or user is disabled.")
                return "OK"
            case "SELECT":
                if a[0] != "0":
                    raise CommandError("ERR DB index is out of range")
                return "OK"
            case "WAIT":
                return 0
            case "BGSAVE":
                if a:
                    self.save(a[0])
                return "Background saving started"
            case "BGREWRITEAOF":
                if a:
                    snapshot.rewrite(self.spark, a[0])
                return "Background append only file rewriting started"
            case "QUIT":
                return "OK"
        raise CommandError(f"ERR unknown command '{name}'")


def project(doc: dict, paths: list[str]) -> dict:
    """The leaf paths of a document, their nesting kept; paths to objects and unknown ones give nothing."""
    out: dict = {}
    for path in paths:
        *parents, last = path.split(".")
        at, into = doc, out
        for p in parents:
            at = at.get(p) if isinstance(at, dict) else None
        if isinstance(at, dict) and last in at and not (isinstance(at[last], dict) and at[last]):
            for p in parents:
                into = into.setdefault(p, {})
            into[last] = at[last]
    return out


def parse_mutations(words: list[str]) -> list[tuple]:
    """SET path json | DEL path | INCR path number | PUSH path json | PULL path json, in order."""
    out = []
    while words:
        op = words.pop(0).upper()
        if op not in ("SET", "DEL", "INCR", "PUSH", "PULL"):
            raise CommandError(f"ERR unknown mutation {op}")
        path = words.pop(0)
        if op == "DEL":
            out.append((op, path))
            continue
        try:
            value = json.loads(words.pop(0))
        except ValueError:
            raise CommandError("ERR invalid JSON") from None
        if op == "INCR" and (isinstance(value, bool) or not isinstance(value, int | float)):
            raise CommandError("ERR INCR needs a number")
        out.append((op, path, value))
    if not out:
        raise CommandError("ERR no mutation")
    return out


def _leaf_paths(kind: str) -> list[str]:
    """Leaf paths of an object type's text such as OBJECT<a: BIGINT, b: OBJECT<c: STRING>>."""
    out: list[str] = []

    def walk(text: str, prefix: str) -> None:
        depth, begin, parts = 0, 0, []
        for i, ch in enumerate(text):
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                parts.append(text[begin:i])
                begin = i + 1
        for part in [*parts, text[begin:]]:
            name, _, t = part.strip().partition(": ")
            if t.startswith("OBJECT<"):
                walk(t[7:-1], f"{prefix}{name}.")
            elif name:
                out.append(prefix + name)

    if kind and kind.startswith("OBJECT<"):
        walk(kind[7:-1], "")
    return out


