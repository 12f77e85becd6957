"""Lists, registry, paged source, cursors and manifests."""

import pytest
from pyspark.sql import functions as F

from arborlake.plans import lists
from arborlake.sources import registry

SPEC = lists.ListSpec(text=["name"], equal=["rank"], flags=["extinct"], ranges=["n"], sorts=["n"], tie=["name"])


def test_query_list(spark):
    df = spark.createDataFrame([("Aus", "genus", True, 3), ("Aus bus", "Species", None, 1), ("Bus", "genus", False, None)], "name string, rank string, extinct boolean, n int")
    names = lambda **p: [r.name for r in lists.query_list(df, SPEC, **p).collect()]
    assert names(q=" aus") == ["Aus", "Aus bus"] and names(rank="GENUS", sort="n", direction="desc") == ["Aus", "Bus"] and names(extinct=False) == ["Aus bus", "Bus"] and names(min_n=2) == ["Aus"] and names(limit=1, offset=1) == ["Aus bus"]
    for bad in ({"x": 1}, {"extinct": "yes"}, {"sort": "rank"}):
        with pytest.raises(lists.ListError):
            lists.query_list(df, SPEC, **bad)


def test_flatten(spark):
    df = spark.sql("select named_struct('b', named_struct('c', 1), 'd', array(1)) as a, 2 as e")
    assert lists.flatten_columns(df).columns == ["a.b.c", "a.d", "e"]
    leaves = lists.flatten_paths(spark.createDataFrame([(1, '{"a":{"b":[1,"x"]},"c":null}'), (2, "bad"), (3, None)], "id int, j string"), "id", "j").collect()
    assert {(r.id, r.path, r.value) for r in leaves if r.path != "c"} == {(1, "a.b[0]", "1"), (1, "a.b[1]", "x")}


def test_paged_source(spark):
    spark.dataSource.register(registry.PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("arborlake_paged").options(fetch="arborlake.sources.registry:demo", schema="id string, kind string", total="25", page="10").load()
    assert df.count() == 25 and df.where("kind = 'a'").count() == 13


def test_registry():
    r = registry.Registry()
    r.add("one", {"module": "m"})
    r.add("two", {"module": "m", "enabled": False})
    r.add("three", {"module": "m", "requires": ["KEY"]})
    assert r.eligible() == (["one"], {"two": "disabled", "three": "missing KEY"}) and r.eligible(present={"KEY"})[0] == ["one", "three"]
    assert registry.definition_issues("", {"endpoint": "ftp://x", "batch_size": 0, "enabled": 1}) == ["provider_name_missing", "provider_module_missing", "provider_enabled_not_boolean", "provider_batch_size_invalid", "provider_endpoint_not_http"]
    assert registry.cursor_issues({"a": {1}}) == ["cursor_not_serializable"] and registry.cursor_issues("x" * 70000) == ["cursor_too_long"] and registry.cursor_issues(None) == []


def test_state_and_manifest(spark):
    old = spark.createDataFrame([("a", "10", 1, "x", "t0")], "source string, cursor string, failures int, last_error string, updated_at string")
    fail = registry.save_state(old, "a", None, "boom", "t1")
    assert tuple(fail.first()) == ("a", "10", 2, "boom", "t1")
    assert tuple(registry.save_state(fail, "a", "20", None, "t2").first()) == ("a", "20", 0, None, "t2")
    m = registry.Manifest()
    m.set("a.b", 1)
    assert m.increment("a.b") == 2 and m.get("a.c", 5) == 5 and m.delete("a.b") and not m.delete("a.b")
    m.sync(spark.createDataFrame([("s", "v1"), ("s", "v2")], "speciedex_id string, volume_file string"))
    assert m.data["counters"] == {"records": 1, "volumes": 2}


def test_named_filters(spark):
    df = spark.createDataFrame([(0.4,), (60.0,), (None,)], "c double")
    assert [r[0] for r in df.select(lists.low_confidence(F.col("c"))).collect()] == [True, False, True]


def test_leaves_of_any_depth(spark):
    deep = '{"a":[{"b":{"c":{"d":[[1,{"e":"x"}]]}}}],"n":{}}'
    rows = lists.flatten_paths(spark.createDataFrame([(1, deep), (2, None), (3, "bad"), (4, "")], "id int, j string"), "id", "j").collect()
    assert {(r.id, r.path, r.value) for r in rows} == {(1, "a[0].b.c.d[0][0]", "1"), (1, "a[0].b.c.d[0][1].e", "x")}
    assert lists.flatten_paths(spark.createDataFrame([], "id int, j string"), "id", "j").count() == 0
