"""The command catalogue: names by family. Replies and arguments are in tessera.database."""

from __future__ import annotations

# The command names of the protocol.
FAMILIES: dict[str, tuple[str, ...]] = {
    "string": tuple("GET SET GETSET APPEND STRLEN INCR DECR INCRBY DECRBY INCRBYFLOAT GETRANGE SUBSTR SETRANGE GETDEL GETEX MGET MSET MSETNX SETNX SETEX PSETEX".split()),
    "keyspace": tuple("DEL UNLINK EXISTS EXPIRE PEXPIRE EXPIREAT PEXPIREAT PERSIST TTL PTTL TYPE KEYS SCAN DBSIZE FLUSHDB FLUSHALL RENAME RENAMENX COPY RANDOMKEY TOUCH OBJECT DUMP".split()),
    "list": tuple("LPUSH RPUSH LPOP RPOP LLEN LRANGE LINDEX LSET LINSERT LREM LTRIM LPOS RPOPLPUSH LMOVE BLPOP BRPOP BLMOVE".split()),
    "hash": tuple("HSET HMSET HGET HMGET HDEL HGETALL HLEN HEXISTS HKEYS HVALS HINCRBY HINCRBYFLOAT HSETNX HRANDFIELD HSCAN".split()),
    "set": tuple("SADD SREM SMEMBERS SISMEMBER SMISMEMBER SCARD SPOP SRANDMEMBER SUNION SINTER SDIFF SUNIONSTORE SINTERSTORE SDIFFSTORE SINTERCARD SMOVE SSCAN".split()),
    "zset": tuple("ZADD ZREM ZSCORE ZMSCORE ZINCRBY ZCARD ZRANK ZREVRANK ZRANGE ZREVRANGE ZRANGEBYSCORE ZREVRANGEBYSCORE ZCOUNT ZPOPMIN ZPOPMAX BZPOPMIN BZPOPMAX ZRANGEBYLEX ZREVRANGEBYLEX ZLEXCOUNT ZRANDMEMBER ZSCAN".split()),
    "stream": tuple("XADD XLEN XRANGE XREVRANGE XREAD XTRIM XDEL XGROUP XREADGROUP XACK XPENDING XCLAIM XAUTOCLAIM XINFO".split()),
    "hyperloglog": ("PFADD", "PFCOUNT", "PFMERGE"),
    "bitmap": tuple("SETBIT GETBIT BITCOUNT BITOP BITPOS BITFIELD".split()),
    "geo": tuple("GEOADD GEODIST GEOHASH GEOPOS GEOSEARCH".split()),
    "vector": ("VECSET", "VECQUERY", "VECDEL"),
    "document": tuple(f"DOC.{x}" for x in "CREATE DROP INFO DICTINFO STORAGE SET INSERT MSET GET MGET UPDATE DEL EXISTS CREATEINDEX DROPINDEX INDEXES FIND COUNT".split()),
    "pubsub": tuple("SUBSCRIBE UNSUBSCRIBE PSUBSCRIBE PUNSUBSCRIBE PUBLISH".split()),
    "cdc": ("CDCPOLL", "CDC.GROUP", "CDC.ACK", "CDC.PENDING"),
    "stats": ("STATS.HOTKEYS", "STATS.LATENCY", "STATS.MEMORY"),
    "transaction": tuple("MULTI EXEC DISCARD WATCH UNWATCH".split()),
    "server": tuple("PING ECHO INFO COMMAND CONFIG CLIENT HELLO AUTH SELECT TIME WAIT QUIT BGSAVE BGREWRITEAOF".split()),
}


def names() -> list[str]:
    return sorted(n for ns in FAMILIES.values() for n in ns)


def family(name: str) -> str | None:
    return next((f for f, ns in FAMILIES.items() if name.upper() in ns), None)


def table(spark):
    """(name, family): what COMMAND LIST, COUNT and DOCS report."""
    return spark.createDataFrame([(n, f) for f, ns in FAMILIES.items() for n in ns], "name string, family string")
