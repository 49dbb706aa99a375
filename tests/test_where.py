"""The WHERE language: grammar, and Columns against a plain evaluator on random documents."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import CommandError
from tessera.functions.predicates import where
from tessera.plans.where import And, Compare, Exists, Find, In, Not, Or, parse_find, parse_where

MISSING = object()


def lookup(doc, path):
    for p in path.split("."):
        if not isinstance(doc, dict) or p not in doc:
            return MISSING
        doc = doc[p]
    return doc


def same(v, lit):
    if v is MISSING:
        return False
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(v) and number(lit):
        return float(v) == float(lit)
    return type(v) is type(lit) and v == lit


def holds(e, doc):
    match e:
        case And(a, b):
            return holds(a, doc) and holds(b, doc)
        case Or(a, b):
            return holds(a, doc) or holds(b, doc)
        case Not(a):
            return not holds(a, doc)
        case Exists(p):
            return lookup(doc, p) is not MISSING
        case In(p, vs):
            return any(same(lookup(doc, p), v) for v in vs)
        case Compare(p, "=", v):
            return same(lookup(doc, p), v)
        case Compare(p, "!=", v):
            return not same(lookup(doc, p), v)
        case Compare(p, "CONTAINS", v):
            got = lookup(doc, p)
            return isinstance(got, list) and any(same(x, v) for x in got)
        case Compare(p, op, v):
            got = lookup(doc, p)
            if isinstance(got, bool) or not isinstance(got, int | float):
                return False
            return {">": got > v, ">=": got >= v, "<": got < v, "<=": got <= v}[op]


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("a = 1", Compare("a", "=", 1)),
        ("a.b != 'x y'", Compare("a.b", "!=", "x y")),
        ("a = 1 OR b = 2 AND c = 3", Or(Compare("a", "=", 1), And(Compare("b", "=", 2), Compare("c", "=", 3)))),
        ("NOT a = 1 AND b EXISTS", And(Not(Compare("a", "=", 1)), Exists("b"))),
        ("NOT (a = 1 and b = null)", Not(And(Compare("a", "=", 1), Compare("b", "=", None)))),
        ('a in ("x", -2.5, TRUE)', In("a", ("x", -2.5, True))),
        ("tags contains 'rust'", Compare("tags", "CONTAINS", "rust")),
    ],
)
def test_trees(text, tree):
    assert parse_where(text) == tree


@pytest.mark.parametrize("text", ["", "a", "a =", "a > 'x'", "a IN ()", "a = 1 b", "(a = 1", "a <> 1", "a-b = 1", "a = 'open", "AND = 1", "a = 1e5x", "= 1"])
def test_refused(text):
    with pytest.raises(CommandError):
        parse_where(text)


def test_find_clauses():
    got = parse_find("WHERE age > 20 AND name = 'x' ORDER BY a.b desc LIMIT 5 PROJECT n m OFFSET 2 LIMIT 7".split(" "))
    assert got == Find("age > 20 AND name = 'x'", "a.b", True, ("n", "m"), 7, 2)
    for bad in (["a", "=", "1"], ["WHERE", "a", "EXISTS", "LIMIT", "x"], ["WHERE", "a", "EXISTS", "ORDER", "a"], ["WHERE", "a", "EXISTS", "PROJECT"]):
        with pytest.raises(CommandError):
            parse_find(bad)


VALUES = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([0.5, 1.0, -2.0]), st.sampled_from(["", "a", "5", "true"]), st.lists(st.sampled_from([1, "a", True, None]), max_size=3))
DOCS = st.dictionaries(st.sampled_from(["a", "b", "c"]), st.one_of(VALUES, st.dictionaries(st.sampled_from(["x", "y"]), VALUES, max_size=2)), max_size=3)
EXPRS = ["a = 1", "a != 1", "a = 'a'", "a = null", "NOT a = null", "a > 0", "b <= 1.5", "a.x = true", "NOT a.x EXISTS", "c CONTAINS 1", "c CONTAINS 'a'", "c CONTAINS null", "a IN (1, 'a', null)", "NOT (a > 0 OR b > 0)", "a EXISTS AND NOT b EXISTS", "a = '5' OR a = 5"]


@settings(max_examples=5, deadline=None)
@given(st.lists(DOCS, min_size=30, max_size=30))
def test_variant_columns_equal_the_evaluator(spark, docs):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("body")).cache()
    for text in EXPRS:
        want = [i for i, d in enumerate(docs) if holds(parse_where(text), d)]
        assert sorted(r["i"] for r in where(df, text, "body").collect()) == want, text


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, "a", None, (1.5, "n"), ["x", "y"]), (2, None, True, (None, "m"), None), (3, "b", False, None, [])], "id int, s string, f boolean, t struct<v:double,n:string>, l array<string>")
    ids = lambda text: [r["id"] for r in where(df, text).orderBy("id").collect()]
    assert ids("s = 'a'") == [1]
    assert ids("s != 'a'") == [2, 3]
    assert ids("NOT s = 'a'") == [2, 3]
    assert ids("t.v >= 1") == [1]
    assert ids("NOT t.v >= 1") == [2, 3]
    assert ids("f = true OR f = 'true'") == [2]
    assert ids("l CONTAINS 'x'") == [1]
    assert ids("s > 1 OR s = 1 OR id = '1' OR nothing EXISTS") == []
    assert ids("t.n EXISTS") == [1, 2]
    assert ids("s = null") == []


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.range(100).selectExpr("id", "id % 7 as k").write.parquet(str(tmp_path / "t"))
    where(spark.read.parquet(str(tmp_path / "t")), "k = 3 AND id > 50").explain()
    assert "EqualTo(k,3)" in (plan := capsys.readouterr().out) and "GreaterThan(id,50)" in plan
