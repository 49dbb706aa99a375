"""Commands end to end, from the semantics of their families."""

from datetime import datetime, timedelta

import pytest

from tessera.database import Database, project
from tessera.errors import CommandError, WrongType
from tessera.operators.docs import mutate
from tessera.plans import commands


class Clock:
    now = datetime(2024, 1, 1)

    def __call__(self):
        return self.now


@pytest.fixture
def db(spark):
    clock = Clock()
    out = Database(spark, clock, cut_after=1)
    out.test_clock = clock
    return out


def run(db, text):
    return db.execute(*text.split(" "))


def test_strings(db):
    assert run(db, "SET k hello") == "OK" and run(db, "GET k") == b"hello"
    assert run(db, "APPEND k -x") == 7 and run(db, "STRLEN k") == 7
    assert run(db, "GETRANGE k -3 -1") == b"o-x" and run(db, "SETRANGE k 1 EY") == 7
    assert run(db, "SET k v NX") is None and run(db, "SET q v XX") is None
    assert run(db, "INCR n") == 1 and run(db, "INCRBY n 41") == 42 and run(db, "DECR n") == 41
    assert run(db, "INCRBYFLOAT n 0.5") == "41.5"
    with pytest.raises(CommandError, match="not an integer"):
        run(db, "INCR k")
    run(db, f"SET big {2**63 - 1}")
    with pytest.raises(CommandError, match="overflow"):
        run(db, "INCR big")
    assert run(db, "MSET a 1 b 2 a 3") == "OK" and run(db, "MGET a b zz a") == [b"3", b"2", None, b"3"]
    assert run(db, "MSETNX a 1 c 2") == 0 and run(db, "GETDEL a") == b"3" and run(db, "GET a") is None


def test_expiry(db):
    run(db, "SET k v EX 100")
    assert run(db, "TTL k") == 100 and run(db, "PTTL k") == 100_000 and run(db, "TTL no") == -2
    assert run(db, "PERSIST k") == 1 and run(db, "TTL k") == -1 and run(db, "PERSIST k") == 0
    assert run(db, "EXPIRE k 10") == 1
    db.test_clock.now += timedelta(seconds=11)
    assert run(db, "GET k") is None and run(db, "EXISTS k") == 0 and run(db, "SET k w NX") == "OK"
    assert run(db, "EXPIREAT k 1") == 1 and run(db, "GET k") is None


def test_keyspace(db):
    run(db, "MSET user:1 a user:2 b other c")
    run(db, "RPUSH l 1")
    assert run(db, "KEYS user:?") == ["user:1", "user:2"] and run(db, "TYPE l") == "list" and run(db, "TYPE no") == "none"
    assert run(db, "SCAN 0 COUNT 3") == ["3", ["l", "other", "user:1"]] and run(db, "SCAN 3 COUNT 3") == ["0", ["user:2"]]
    assert run(db, "RENAME user:1 moved") == "OK" and run(db, "GET moved") == b"a"
    assert run(db, "COPY moved other") == 0 and run(db, "COPY moved other REPLACE") == 1
    assert run(db, "DEL moved l no") == 2 and run(db, "EXISTS other other") == 2
    with pytest.raises(CommandError, match="no such key"):
        run(db, "RENAME no x")
    with pytest.raises(WrongType):
        run(db, "RPUSH other x")
    assert run(db, "FLUSHDB") == "OK" and run(db, "DBSIZE") == 0


def test_lists(db):
    assert run(db, "RPUSH l a b c a b a") == 6 and run(db, "LPUSH p 1 2") == 2 and run(db, "LRANGE p 0 -1") == ["2", "1"]
    assert run(db, "LPOS l a") == 0 and run(db, "LPOS l a RANK 2") == 3 and run(db, "LPOS l a COUNT 0") == [0, 3, 5] and run(db, "LPOS l a RANK -1 COUNT 2") == [5, 3]
    assert run(db, "LRANGE l 0 -100") == ["a"] and run(db, "LRANGE l -2 9") == ["b", "a"]
    assert run(db, "LINSERT l BEFORE c x") == 7 and run(db, "LINDEX l 2") == "x" and run(db, "LINDEX l -100") == "a"
    assert run(db, "LREM l -2 a") == 2 and run(db, "LRANGE l 0 -1") == ["a", "b", "x", "c", "b"]
    assert run(db, "LSET l 1 B") == "OK" and run(db, "LPOP l") == "a" and run(db, "LTRIM l 0 1") == "OK" and run(db, "LRANGE l 0 -1") == ["B", "x"]
    assert run(db, "RPOPLPUSH l p") == "x" and run(db, "LRANGE p 0 -1") == ["x", "2", "1"] and run(db, "BLPOP no p 0") == ["p", "x"]
    with pytest.raises(CommandError, match="out of range"):
        run(db, "LSET l 9 z")


def test_hashes_and_sets(db):
    assert run(db, "HSET h b 2 a 1") == 2 and run(db, "HSET h a 9 c 3") == 1 and run(db, "HGETALL h") == {"a": "9", "b": "2", "c": "3"}
    assert run(db, "HMGET h a zz") == ["9", None] and run(db, "HINCRBY h a 5") == 14 and run(db, "HSETNX h a 1") == 0 and run(db, "HDEL h b c") == 2 and run(db, "HLEN h") == 1
    assert run(db, "HSCAN h 0") == ["0", ["a", "14"]]
    run(db, "SADD x a b c")
    run(db, "SADD y b c d")
    assert run(db, "SINTER x y") == ["b", "c"] and run(db, "SUNION x y") == ["a", "b", "c", "d"] and run(db, "SDIFF x y") == ["a"]
    assert run(db, "SINTERSTORE z x y") == 2 and run(db, "SINTERCARD 2 x y LIMIT 1") == 1 and run(db, "SINTER x no") == []
    assert run(db, "SMOVE x y a") == 1 and run(db, "SMISMEMBER y a q") == [1, 0] and len(run(db, "SRANDMEMBER y -7")) == 7
    assert len(run(db, "SPOP y 2")) == 2 and run(db, "SCARD y") == 2 and run(db, "SDIFFSTORE z x x") == 0 and run(db, "EXISTS z") == 0


def test_sorted_sets(db):
    assert run(db, "ZADD z 1 a 2 b 3 c") == 3 and run(db, "ZADD z 5 a 4 d") == 1 and run(db, "ZSCORE z a") == "5"
    assert run(db, "ZRANGE z 0 -1 WITHSCORES") == ["b", "2", "c", "3", "d", "4", "a", "5"] and run(db, "ZREVRANGE z 0 1") == ["a", "d"]
    assert run(db, "ZRANK z c") == 1 and run(db, "ZREVRANK z c") == 2 and run(db, "ZRANK z no") is None
    assert run(db, "ZREVRANGEBYSCORE z 4 2 LIMIT 1 2") == ["c", "b"] and run(db, "ZCOUNT z -inf 3") == 2 and run(db, "ZINCRBY z 1.5 b") == "3.5"
    run(db, "ZADD s 0 a 0 b 0 c 0 d 0 e")
    assert run(db, "ZRANGEBYLEX s [b [d") == ["b", "c", "d"] and run(db, "ZRANGEBYLEX s (b +") == ["c", "d", "e"] and run(db, "ZLEXCOUNT s - +") == 5
    assert run(db, "ZPOPMIN s 2") == ["a", "0", "b", "0"] and run(db, "ZPOPMAX s") == ["e", "0"] and run(db, "BZPOPMIN no s 0") == ["s", ["c", "0"]]
    with pytest.raises(CommandError):
        run(db, "ZADD z x a")


def test_streams_and_groups(db):
    for i in (1, 2, 3):
        assert run(db, f"XADD s {i}-0 f v{i}") == f"{i}-0"
    with pytest.raises(CommandError, match="equal or smaller"):
        run(db, "XADD s 3-0 f v")
    assert run(db, "XRANGE s 2-0 + COUNT 1") == [["2-0", ["f", "v2"]]] and run(db, "XREVRANGE s + - COUNT 1") == [["3-0", ["f", "v3"]]]
    assert run(db, "XREAD COUNT 1 STREAMS s 1-0") == [["s", [["2-0", ["f", "v2"]]]]] and run(db, "XREAD STREAMS s $") is None
    assert run(db, "XGROUP CREATE s g 0") == "OK"
    with pytest.raises(CommandError, match="BUSYGROUP"):
        run(db, "XGROUP CREATE s g 0")
    assert [e[0] for e in run(db, "XREADGROUP GROUP g c1 COUNT 2 STREAMS s >")[0][1]] == ["1-0", "2-0"]
    assert run(db, "XPENDING s g") == [2, "1-0", "2-0", [["c1", "2"]]] and run(db, "XACK s g 1-0") == 1
    db.test_clock.now += timedelta(seconds=5)
    assert run(db, "XPENDING s g - + 10") == [["2-0", "c1", 5000, 1]]
    assert run(db, "XCLAIM s g c2 9000 2-0") == [] and run(db, "XAUTOCLAIM s g c2 1000 0-0")[0] == "2-1"
    assert run(db, "XPENDING s g - + 10") == [["2-0", "c2", 0, 2]]
    assert run(db, "XTRIM s MAXLEN 1") == 2 and run(db, "XLEN s") == 1 and run(db, "XDEL s 3-0") == 1
    assert run(db, "XADD s * f v") == f"{db.now_ms()}-0" and run(db, "XADD s * f v") == f"{db.now_ms()}-1"


def test_bits(db):
    run(db, "SET k foobar")
    assert [run(db, f"BITCOUNT k{x}") for x in ("", " 0 0", " 1 1", " 5 30 BIT", " -1 -1")] == [26, 4, 6, 17, 4]
    assert run(db, "SETBIT b 7 1") == 0 and run(db, "GETBIT b 7") == 1 and run(db, "GET b") == b"\x01" and run(db, "BITPOS b 1") == 7 and run(db, "BITPOS b 0") == 0
    assert run(db, "BITPOS none 0") == 0 and run(db, "BITPOS none 1") == -1
    run(db, "BITFIELD f SET u8 0 255")
    assert run(db, "BITPOS f 0") == 8
    assert run(db, "BITFIELD f OVERFLOW SAT INCRBY u8 0 1 OVERFLOW FAIL INCRBY u8 0 1 OVERFLOW WRAP INCRBY u8 0 1") == [255, None, 0]
    assert run(db, "BITFIELD f SET i5 #1 -3 GET i5 #1 GET u8 0") == [0, -3, 7]
    db.execute("SET", "x", "abc")
    assert run(db, "BITOP AND d k x") == 6 and run(db, "GET d") == bytes(a & b for a, b in zip(b"foobar", b"abc\0\0\0", strict=True))


def test_positions_vectors_and_sketches(db):
    assert run(db, "GEOADD g 13.361389 38.115556 Palermo 15.087269 37.502669 Catania 2.349014 48.864716 Paris") == 3
    assert float(run(db, "GEODIST g Palermo Catania km")) == pytest.approx(166.2742, abs=0.01)
    assert run(db, "GEOSEARCH g FROMLONLAT 15 37 BYRADIUS 200 km ASC") == ["Catania", "Palermo"] and run(db, "GEOSEARCH g FROMMEMBER no BYRADIUS 1 km") == []
    assert run(db, "GEOHASH g Palermo")[0][:8] == "sqc8b49r" and run(db, "GEOPOS g no") == [None]
    assert run(db, "GEOADD g XX CH 1 1 Paris 2 2 New") == 1
    for i in range(10):
        db.execute("VECSET", "v", 8, *[(i * 8 + d) * 0.01 for d in range(8)])
    first = db.execute("VECQUERY", "v", 1, *[(4 * 8 + d) * 0.01 for d in range(8)])[0]
    assert first[1] == pytest.approx(0, abs=1e-6)
    with pytest.raises(CommandError):
        run(db, "VECSET v 2 1 2")
    assert run(db, "PFADD p a b c") == 1 and run(db, "PFADD p a") == 0 and run(db, "PFADD q c d") == 1 and run(db, "PFCOUNT p q") == 4 and run(db, "PFMERGE r p q") == "OK" and run(db, "PFCOUNT r") == 4


def test_documents(db):
    run(db, "DOC.CREATE users")
    db.execute("DOC.SET", "users", "a", '{"name": "Alice", "age": 30, "address": {"city": "Accra", "zip": "00233"}, "tags": ["rust", "systems"]}')
    db.execute("DOC.MSET", "users", "b", '{"name": "Bob"}', "c", '{"name": "Charlie", "age": 20}')
    assert db.execute("DOC.GET", "users", "a", "FIELDS", "name", "address.city", "address") == {"name": "Alice", "address": {"city": "Accra"}}
    names = lambda text: [d["name"] for d in db.execute("DOC.FIND", "users", *text.split(" "))]
    assert names("WHERE age != 20") == ["Alice", "Bob"] and names("WHERE tags CONTAINS 'rust'") == ["Alice"]
    assert names("WHERE name EXISTS ORDER BY age") == ["Charlie", "Alice", "Bob"] and names("WHERE name EXISTS ORDER BY age DESC") == ["Bob", "Alice", "Charlie"]
    assert names("WHERE name EXISTS LIMIT 1 OFFSET 1 PROJECT name") == ["Bob"] and run(db, "DOC.COUNT users WHERE age >= 20") == 2
    assert db.execute("DOC.UPDATE", "users", "a", "SET", "address.city", '"London"', "INCR", "age", "1", "PUSH", "tags", '"x"', "PULL", "tags", '"rust"', "DEL", "name") == 1
    assert run(db, "DOC.GET users a") == {"age": 31, "address": {"city": "London", "zip": "00233"}, "tags": ["systems", "x"]}
    assert run(db, "DOC.INSERT users {}") == "3" and run(db, "DOC.EXISTS users 3") == 1 and run(db, "DOC.DEL users 3") == 1 and run(db, "DOC.MGET users b zz") == [{"name": "Bob"}, None]
    assert run(db, "DOC.CREATEINDEX users name unique") == "OK" and run(db, "DOC.INDEXES users") == [["name", "unique"]]
    with pytest.raises(CommandError, match="unique"):
        db.execute("DOC.SET", "users", "d", '{"name": "Bob"}')
    for bad in ("[1]", "{", '{"a.b": 1}', '{"": 1}'):
        with pytest.raises(CommandError):
            db.execute("DOC.SET", "users", "x", bad)
    assert run(db, "DOC.DICTINFO users") == {"address.city": 1, "address.zip": 1, "name": 2}
    assert run(db, "DOC.STORAGE users")["doc_count"] == 3 and run(db, "DOC.INFO users")["doc_count"] == 3 and run(db, "DOC.DROP users") == 1


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([("SET", "x.y", 1)], {"n": 1, "l": [1, 1.0, "1"], "x": {"y": 1}}),
        ([("INCR", "n", 0.5), ("INCR", "n", 0.5)], {"n": 2, "l": [1, 1.0, "1"]}),
        ([("PULL", "l", 1)], {"n": 1, "l": [1.0, "1"]}),
        ([("DEL", "zz.q")], {"n": 1, "l": [1, 1.0, "1"]}),
        ([("PUSH", "new", 1)], {"n": 1, "l": [1, 1.0, "1"], "new": [1]}),
    ],
)
def test_mutations(ops, want):
    got = mutate({"n": 1, "l": [1, 1.0, "1"]}, ops)
    assert got == want and repr(got) == repr(want)


@pytest.mark.parametrize("op", [("SET", "n.x", 1), ("INCR", "zz", 1), ("INCR", "l", 1), ("PUSH", "n", 1), ("PULL", "n", 1), ("DEL", "n.x")])
def test_refused_mutations(op):
    with pytest.raises(CommandError):
        mutate({"n": 1, "l": []}, [op])


def test_projection_resolves_leaves_only():
    doc = {"a": {"b": 1, "c": {"d": 2}}, "e": {}}
    assert project(doc, ["a.b", "a.c", "a.c.d", "e", "zz"]) == {"a": {"b": 1, "c": {"d": 2}}, "e": {}}


def test_messages_log_and_transactions(db, tmp_path):
    run(db, "SUBSCRIBE news")
    run(db, "PSUBSCRIBE n*")
    assert run(db, "PUBLISH news hi") == 2 and run(db, "PUBLISH other hi") == 0
    before = db.t["kv"]
    run(db, "MSET k1 a k2 b")
    assert db.record(before, db.t["kv"]) == 2
    assert run(db, "CDCPOLL 0 10")[0] == 2 and run(db, "CDC.GROUP CREATE x g 0") == "OK"
    assert [e[0] for e in run(db, "CDC.GROUP READ x g c 1")] == [0] and run(db, "CDC.PENDING x g") == [[0, "c", 0, 1]] and run(db, "CDC.ACK x g 0") == 1
    run(db, "MULTI")
    assert run(db, "SET t 1") == "QUEUED" and run(db, "INCR t") == "QUEUED" and run(db, "LPOP t") == "QUEUED"
    out = run(db, "EXEC")
    assert out[:2] == ["OK", 2] and isinstance(out[2], WrongType)
    assert run(db, "STATS.MEMORY k t") == [["k", 6], ["t", 2]]
    db.save(str(tmp_path / "snap"))
    assert Database.load(db.spark, str(tmp_path / "snap"), now=db.clock).execute("GET", "k1") == b"a"


def test_server_commands(db):
    assert run(db, "PING") == "PONG" and run(db, "ECHO x") == "x" and run(db, "COMMAND COUNT") == len(commands.names()) == len(run(db, "COMMAND LIST"))
    assert run(db, "CONFIG SET maxmemory 5") == "OK" and run(db, "CONFIG GET max*") == {"maxmemory": "5"} and run(db, "SELECT 0") == "OK" and run(db, "HELLO 3")["proto"] == 3
    with pytest.raises(CommandError, match="unknown command"):
        run(db, "NOPE")
    with pytest.raises(CommandError, match="wrong number"):
        run(db, "GET")
