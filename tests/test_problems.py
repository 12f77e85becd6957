"""Hierarchies, nested records and orphan references against small brute force and edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arborlake.functions import jsonindex
from arborlake.functions.keys import instant, record_id
from arborlake.operators import flatten, hierarchy, orphans


def walk(links, node):
    path, seen = [node], {node}
    while (up := links.get(path[-1])) is not None and up in links:
        if up in seen:
            loop = path[path.index(up):]
            return None, min(loop)
        path.append(up)
        seen.add(up)
    return path, None


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_walking(spark, seed):
    rng = random.Random(seed)
    names = [f"k{i:03d}" for i in range(300)]
    links = {n: (None if rng.random() < 0.05 else rng.choice(["gone", *names]) if rng.random() < 0.3 else names[rng.randrange(max(1, i))]) for i, n in enumerate(names)}
    links |= {f"c{i}": f"c{i + 1}" for i in range(120)}
    links["c120"] = None
    links |= {f"l{i}": f"l{(i + 1) % 37}" for i in range(37)} | {"self": "self", "below": "l5"}
    df = spark.createDataFrame(list(links.items()), "node string, up string").repartition(5)
    got = {r.node: r for r in hierarchy.resolve(df, with_paths=True).collect()}
    assert len(got) == len(links)
    for n in links:
        path, cycle = walk(links, n)
        r = got[n]
        assert r.cycle_key == cycle
        if path:
            assert (r.path, r.depth, r.root) == (path[::-1], len(path) - 1, path[-1])
        else:
            assert (r.path, r.depth, r.root) == (None, None, None)
    pairs = {(r.ancestor, r.descendant, r.distance) for r in hierarchy.descendants(hierarchy.resolve(df, True)).collect()}
    want = {(a, n, i + 1) for n in links if (p := walk(links, n)[0]) for i, a in enumerate(p[1:])}
    assert pairs == want


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "node string, up string")
    assert hierarchy.resolve(empty, True).count() == 0


def test_current_links(spark):
    rows = [("a", "p", "", "2024-01-01T00:00:00Z", 1), ("a", "q", None, "20240101T010000Z", 1), ("b", "b", " ", None, 1), ("c", "p", "x", "2024-01-01 00:00:00", 1), ("c", "p", "c", "2023-12-31T23:00:00-02:00", 1), (None, "p", None, None, 1), ("", "p", None, None, 1)]
    df = spark.createDataFrame(rows, "taxon_key string, parent string, acc string, updated string, tie int")
    got = {r.node: r.up for r in hierarchy.current_links(df, "taxon_key", "parent", "acc", "updated").collect()}
    assert got == {"a": "q", "b": "b", "c": "p"}


def slow_items(value, steps):
    """The same walk with the json module."""
    def dec(x):
        while isinstance(x, str):
            try:
                y = json.loads(x)
            except ValueError:
                return x
            if not isinstance(y, (str, list, dict)):
                return x
            x = y
        return x
    def go(x, steps, pos):
        x = dec(x) if isinstance(x, str) else x
        s = steps[0]
        if s[0] == "key":
            if isinstance(x, dict) and s[1] in x:
                yield from go(x[s[1]], steps[1:], pos)
        elif s[0] == "each":
            for i, y in enumerate(x if isinstance(x, list) else [x]):
                yield from go(y, steps[1:], pos + (i,))
        else:
            if isinstance(x, dict):
                x = next((v for k, v in x.items() if jsonindex.spelling(k) in s[1] and isinstance(v, str) and v.strip()), None)
            if isinstance(x, str) and x.strip():
                yield pos, x
    try:
        x = json.loads(value)
    except (ValueError, TypeError):
        return []
    while isinstance(x, str):
        try:
            x = json.loads(x)
        except ValueError:
            return []
    return list(go(x, steps, ()))


def test_items_match_the_slow_walk():
    rng = random.Random(4)
    steps = flatten.FIELDS["assertions.assertion_json"][3]
    def area():
        return rng.choice([None, "", "AB-1", {"code": "C\"\\é-2"}, {"code": None}, {"status": "x"}, {"Code": "CD-3", "z": [1, {"code": "no"}]}])
    def text():
        dist = rng.choice([[], None, "x", {"areas": area()}, [rng.choice([None, {}, {"areas": [area() for _ in range(rng.randrange(4))]}, {"areas": area()}]) for _ in range(rng.randrange(4))]])
        if rng.random() < 0.2:
            dist = json.dumps(dist)
        doc = json.dumps({"a": "[{\\", "distribution": [1], "n": -1.5e3, "t": True, "extra": {"distribution": dist, "other": [[], {}]}}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            doc = json.dumps(doc)
        return doc[: rng.randrange(len(doc))] if rng.random() < 0.2 else doc
    texts = [text() for _ in range(400)] + [None, "", "null", "[]", "{", "}", '{"a":1,}', '{"a" 1}', "[1 2]", "{} {}", '"', '"x', "tru", "01"]
    got = {}
    for i, pos, v in jsonindex.items(texts, steps):
        got.setdefault(i, []).append((pos, v))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(slow_items(t, steps)), t


def test_validity_is_that_of_json():
    bad = ["{", "[1,]", "{,}", '{"a":}', '{"a":1 "b":2}', "[}", "{]", '{"a":1}}', "[1][2]", '["\\x"]', '["a\nb"]', "nul", "-", "1.", "[1,,2]", '{1:2}', ":", ",", ""]
    good = ["{}", "[]", "1", '"a"', "null", '{"a":[1,{"b":"c"}]}', ' [ 1 , "x\\u00e9\\"" ] ', "-0.5e+3", '{"":[]}', "[[],[[]]]"]
    assert list(jsonindex.Index([t.encode() for t in bad + good]).valid) == [False] * len(bad) + [True] * len(good)


def test_flatten_edge_rows(spark):
    df = spark.createDataFrame([("k", None, 1), (None, '[{"metadata":{"alternates":[null,"a",{"name":"b"}]}}]', 2), ("e", "", 3)], "taxon_key string, lineage_json string, item int")
    rows = flatten.nested_items(df, "taxon_key", "lineage_json", flatten.FIELDS["iconforge_taxa.lineage_json"][3]).collect()
    assert sorted((r.record_key, r.outer_pos, r.inner_pos, r.item) for r in rows) == [(None, 0, 1, "a"), (None, 0, 2, "b")]
    assert flatten.nested_items(df.limit(0), "taxon_key", "lineage_json", [("each",), ("key", "metadata"), ("each",), ("item", ("name",))]).count() == 0


def test_orphans(spark):
    ts = "timestamp'2024-01-%02d 00:00:00'"
    taxa = spark.sql(f"select * from values ('SPX:SHA256:AA', {ts % 5}, 'accepted'), ('aa', {ts % 3}, 'accepted'), ('bb', {ts % 1}, 'accepted'), ('bb', {ts % 9}, ' Deleted'), ('cc', {ts % 1}, 'deleted'), ('cc', {ts % 2}, null), (null, {ts % 1}, 'x') t(speciedex_id, loaded_at, status)")
    states = orphans.parent_states(taxa, F.col("speciedex_id"), F.col("loaded_at"), F.col("status"))
    rows = [("early", " spx:sha256:AA ", 2), ("fine", "aa", 3), ("deleted", "bb", 5), ("revived", "cc", 1), ("missing", "zz", 1), ("blank", " ", 1), ("null", None, 1), ("prefix", "spx:sha256:", 1)]
    refs = spark.createDataFrame(rows, "provider_id string, speciedex_id string, d int").selectExpr("'p' as provider", "provider_id", "speciedex_id", "make_timestamp(2024, 1, d, 0, 0, 0) as loaded_at", "'x' as key", "'y' as salt")
    found = orphans.orphans(orphans.references(refs, "source_ids", "provider_id"), states)
    assert {r.ref_id: r.why for r in found.collect()} == {"early": "early", "deleted": "deleted", "missing": "missing"}
    report = orphans.orphan_report(orphans.references(refs, "source_ids", "provider_id"), found).collect()
    assert [(r.period, r.refs, r.orphans) for r in report] == [("2024-01", 5, 3)]


def test_keys(spark):
    row = spark.sql("select ' SPX:sha256:AB ' a, '20240102T030405Z' b, '2024-01-02 03:04:05' c, '2024-01-02T05:04:05+02:00' d, '2024-01-02T03:04:05.000Z' e, 'soon' f")
    r = row.select(record_id(F.col("a")).alias("a"), *[F.date_format(instant(F.col(c)), "yyyy-MM-dd HH:mm:ss").alias(c) for c in "bcdef"]).first()
    assert r.a == "ab" and {r.b, r.c, r.d, r.e} == {"2024-01-02 03:04:05"} and r.f is None


def plain_rows(x, place="", up=None, path="", pos=0, named=False, listed=False):
    """The linked rows of a parsed value, one by one."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{", '"'):
        try:
            y = json.loads(x)
            if isinstance(y, (dict, list)):
                x, listed = y, False
        except ValueError:
            pass
    if isinstance(x, dict):
        own = {}
        yield place, up, path, 0 if named else pos, own
        for k, v in x.items():
            w = v
            if isinstance(v, str) and v.lstrip()[:1] in ("[", "{"):
                try:
                    w = json.loads(v)
                except ValueError:
                    pass
            if isinstance(w, (dict, list)):
                yield from plain_rows(w, f"{place}.{k}" if place else k, place, f"{path}.{k}" if path else k, pos, True)
            else:
                own[k] = v if isinstance(v, str) or v is None else json.dumps(v)
    elif isinstance(x, list):
        for n, v in enumerate(x):
            yield from plain_rows(v, f"{place}[{n}]", up, path + "[]" if listed else path, n, False, isinstance(v, list))
    elif place:
        yield place, up, path, pos, {"value": x if isinstance(x, str) or x is None else json.dumps(x)}


def test_linked_rows_match_a_plain_walk(spark):
    rng = random.Random(3)

    def value(d):
        r = rng.random()
        if d > 4 or r < 0.4:
            return rng.choice([None, True, 1, 2.5, "x", "", "a.b", 'q"t'])
        if r < 0.7:
            return {rng.choice("abc"): value(d + 1) for _ in range(rng.randrange(3))}
        return [value(d + 1) for _ in range(rng.randrange(4))]

    docs = [value(0) for _ in range(300)] + [{"a": json.dumps({"b": [1, {"c": 2}]})}, [[1, [2]], [{"x": []}]]]
    for doc in docs:
        got = [(r, u, p, n, v) for _, r, u, p, n, v in jsonindex.linked([json.dumps(doc)])]
        assert sorted(got, key=repr) == sorted(plain_rows(doc), key=repr), doc
    df = spark.createDataFrame([("k", '{"h": [{"s": [1, null]}, {"s": {"i": 2}}]}', 1), ("k2", None, 1), (None, "[1]", 1), ("k3", "{bad", 1), ("k4", "", 2), ("k5", json.dumps(json.dumps({"z": 1})), 2)], "key string, js string, path int")
    rows = {(r.record_key, r.path, r.row_key, r.parent_key, r.pos, tuple(sorted(r.fields.items(), key=repr))) for r in flatten.tables(df, "key", "js").collect()}
    assert rows == {("k", "", "", None, 0, ()), ("k", "h", "h[0]", "", 0, ()), ("k", "h", "h[1]", "", 1, ()), ("k", "h.s", "h[0].s[0]", "h[0]", 0, (("value", "1"),)), ("k", "h.s", "h[0].s[1]", "h[0]", 1, (("value", None),)), ("k", "h.s", "h[1].s", "h[1]", 0, (("i", "2"),)), (None, "", "[0]", None, 0, (("value", "1"),)), ("k5", "", "", None, 0, (("z", "1"),))}
    assert flatten.tables(df.limit(0), "key", "js").count() == 0
