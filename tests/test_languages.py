"""Predicates, search strings and dynamic values on small rows."""

import pytest
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.plans import filterlang as L
from arborlake.plans import searchlang as S


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Lion", 5.0, ["a", "b"], [0, 5], None), (2, "lions den", None, [], [], ""), (3, None, -1.0, None, None, "x2"), (4, " LION ", 5.0, ["B"], [1], "x10")],
        "id int, name string, price double, tags array<string>, nums array<int>, code string",
    )


def ids(df, spec, **kw):
    return sorted(r.id for r in df.where(L.compile_filter(df, spec, **kw)).collect())


@pytest.mark.parametrize("spec,want", [
    ({}, [1, 2, 3, 4]), ({"name": "lion"}, [1, 2, 4]), ({"name": {"$eq": "LION"}}, [1, 4]), ({"name": {"$ne": "lion"}}, [2, 3]), ({"name": {"$eq": None}}, [3]), ({"tags": ["A"]}, [1]), ({"price": {"$gte": 0}}, [1, 2, 4]),
    ({"nums": {"$gte": 1, "$lte": 2}}, [1, 4]), ({"$not": {"name": "lion"}}, [3]), ({"$or": [{"id": {"$eq": 3}}, {"tags": {"$contains": "b"}}]}, [1, 3, 4]), ({"price": {"min": 1, "max": 5}}, [1, 4]),
    ({"name": {"$wildcard": "l?on"}}, [1, 4]), ({"name": {"$regex": "/^L/"}}, [1, 4]), ({"name": {"$size": 4}}, [1]), ({"tags": {"$all": ["a", "b"]}}, [1]), ({"tags": {"$none": ["a"]}}, [2, 3, 4]), ({"tags": {"$exists": True}}, [1, 4]),
    ({"nope": "x"}, []), ({"code": {"$gt": "x3"}}, [4]), ([{"id": {"$in": [1, 2]}}, {"id": {"$nin": [2]}}], [1]), ({"$and": [{"id": {"$eq": 1}}], "name": "den"}, []),
])
def test_filters(rows, spec, want):
    assert ids(rows, spec) == want


def test_strict_hides_siblings(rows):
    assert ids(rows, {"$and": [{"id": {"$eq": 1}}], "name": "den"}, strict=True) == [1]
    with pytest.raises(L.FilterError):
        L.compile_filter(rows, {"name": {"$near": 1}})


def test_not_is_the_complement(rows):
    for spec in ({"name": "lion"}, {"price": {"$lt": 3}}, {"tags": {"$eq": "a"}}, {"code": {"$regex": "x"}}):
        assert sorted(ids(rows, spec) + ids(rows, {"$not": spec})) == [1, 2, 3, 4]


def test_page_facet_project(rows):
    page = L.filter_records(rows, None, sort="price", order="desc", limit=2, page=2, facets=["tags"], tie=["id"], select=["id", "tags"])
    assert [r.id for r in page.rows.collect()] == [3, 2] and page.total() == 4 and page.pages() == 2
    assert [(r.value, r["count"]) for r in page.facets["tags"].collect()] == [("B", 1), ("a", 1), ("b", 1)]
    assert [r.tags for r in L.project(rows, ["tags"], collapse=True).collect()] == ['["a","b"]', None, None, "B"]


def test_null_orders(spark):
    df = spark.createDataFrame([(3,), (None,), (1,)], "x int")
    got = {(p, d): [r.x for r in df.orderBy(C.ordering(F.col("x"), d, p)).collect()] for p in C.NULL_ORDER for d in (False, True)}
    assert got == {("worker", False): [1, 3, None], ("worker", True): [3, 1, None], ("grid", False): [None, 1, 3], ("grid", True): [3, 1, None], ("table", False): [1, 3, None], ("table", True): [None, 3, 1]}


def test_natural_key_and_numbers(spark):
    df = spark.createDataFrame([("x10",), ("x2",), ("X1",)], "s string")
    assert [r.s for r in df.orderBy(C.natural_key(F.col("s"))).collect()] == ["X1", "x2", "x10"]
    n = spark.createDataFrame([("",), (" 5 ",), ("0x10",), ("1e3",), ("abc",), ("Infinity",), (None,)], "s string")
    assert [r[0] for r in n.select(C.number(F.col("s"), n.schema["s"].dataType)).collect()] == [0.0, 5.0, 16.0, 1000.0, None, None, None]


def shape(node):
    if node.kind == "term":
        return (node.term.field + node.term.op if node.term.field else "") + node.term.value
    return (node.kind, *map(shape, node.parts))


@pytest.mark.parametrize("text,want", [
    ("a OR b c", ("or", "a", ("and", "b", "c"))), ("-x", ("not", "x")), ("(a OR b) c", ("and", ("or", "a", "b"), "c")), ("", ("all",)), ("NOT a b", ("and", ("not", "a"), "b")), ("rank:species", "rank:species"), ("id=7", "speciedex_id=7"), ('name:"a b"', "name:a b"),
    ("p_size>=3", "p_size>=3"), ("10.1234/abc", "doi=10.1234/abc"), ("Q42", "wikidata_id=Q42"),
])
def test_parse(text, want):
    assert shape(S.parse(text)) == want


@pytest.mark.parametrize("text", ['"open', ")", "(a", "/ab", "a OR"])
def test_parse_errors(text):
    with pytest.raises(S.SearchError):
        S.parse(text)


def test_linear_dialect():
    assert shape(S.parse("a OR b c", "linear")) == ("and", ("or", "a", "b"), "c")
    assert shape(S.parse("--x NOT a", "linear")) == ("not", "a")


def test_fuzzy(spark):
    df = spark.createDataFrame([("panthera",), ("lion",), ("lions",), ("loin",), ("leo",), (None,)], "name string")
    def hits(q, **kw):
        comp = S.Compiler(df, ["name"], **kw)
        return [r.name for r in df.where(comp.match(S.parse(q))).collect()]
    assert hits("pantera") == ["panthera"] and hits("lion") == ["lion", "lions"] and hits("leo") == ["leo"] and hits("pantera", fuzzy=False) == []


def test_search_page(rows):
    page, facets = S.search(rows, "lion", tie=["id"], text_fields=["name"], facets=["tags"])
    assert [(r.id, r.score) for r in page.collect()] == [(1, 10), (4, 10), (2, 6)]
    assert {r.value for r in facets["tags"].collect()} == {"a", "b", "B"}
