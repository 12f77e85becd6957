"""Statistics, timelines, sets, geometry, taxonomy, resolution, sources, sinks and streams on small rows."""

import json
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from arborlake.functions import taxonomy as X
from arborlake.operators import summaries, archive, geo, graph, resolve, sets, stats, timeline
from arborlake.sources import files, sinks
from arborlake.streaming import streams


def one(df):
    return df.first()


def test_summary_and_histogram(spark):
    df = spark.createDataFrame([(1.0, "1"), (2.0, ""), (3.0, "x"), (10.0, None)], "v double, s string")
    r = one(df.agg(*stats.summary(F.col("v"))))
    assert (r.p0, r.p25, r.p50, r.p75, r.p100) == (1, 1.75, 2.5, 4.75, 10) and abs(r.variance - 16.6667) < 1e-3
    assert one(df.limit(1).agg(*stats.summary(F.col("v")))).variance == 0
    p = {r.field: r for r in stats.profile(df, ["v", "s"]).collect()}
    assert (p["s"].nulls, p["s"].distinct_values, p["s"].num_count) == (2, 2, 1)
    bins = lambda xs, n: [(r.bin, r["count"], r.high - r.low) for r in stats.histogram(spark.createDataFrame([(float(x),) for x in xs], "v double"), "v", n).orderBy("bin").collect()]
    assert bins([0, 5, 10], 2) == [(0, 1, 5), (1, 2, 5)] and bins([4, 4], 5) == [(0, 2, 0)]
    assert stats.histogram(df.limit(0), "v", 3).count() == 0
    assert [r.r for r in stats.correlations(spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0)], "a double, b double, c double"), ["a", "b", "c"]).collect()] == [pytest.approx(1.0), None, None]


def test_timeline(spark):
    df = spark.createDataFrame([("2021-01-01T00:00:00", ["x", "x", "y"]), ("2021-01-03T12:00:00", ["x"]), ("bad-date", ["x"]), (None, None)], "t string, g array<string>")
    got = [(r.group, r.bucket, r["count"], r.running) for r in timeline.timeline(df, "t", "day", "g", fill=True, cumulative=True).orderBy("group", "start").collect()]
    assert got == [("x", "2021-01-01", 1, 1), ("x", "2021-01-02", 0, 1), ("x", "2021-01-03", 1, 2), ("y", "2021-01-01", 1, 1)]
    week = one(timeline.timeline(df.limit(1), "t", "week"))
    assert week.bucket == "2020-W53" and str(week.end) == "2021-01-03 23:59:59.999000"
    assert timeline.timeline(df, "t", "year", high="2021-01-02").agg(F.sum("count")).first()[0] == 1


def test_history(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 7), (4, 7), (5, 5)], "t int, v int")
    assert [r.t for r in timeline.collapse_unchanged(df, "t", ["v"]).orderBy("t").collect()] == [2, 4, 5]
    assert [r.delta_v for r in timeline.deltas(df, "t", ["v"], first="value").orderBy("t").collect()] == [5, 0, 2, 0, -2]
    t = one(timeline.trend(df, "t", "v", 3))
    assert (t.first, t.last, t.delta, t.direction) == (7, 5, -2, "down")
    assert [r[0] for r in spark.range(4).select(timeline.backoff(F.col("id"), 10, 30)).collect()] == [0, 10, 20, 30]


def test_overlap(spark):
    left, right = spark.createDataFrame([("a", 1), ("A ", 2), ("b", 3), (None, 4)], "k string, i int"), spark.createDataFrame([("a", 5), ("c", 6), (None, 7)], "k string, i int")
    parts = {n: sorted(r.i for r in d.collect()) for n, d in sets.overlap(left, right, "k").items()}
    assert parts == {"intersection": [1, 2], "left_only": [3, 4], "right_only": [6, 7], "union": [1, 2, 3, 4, 6, 7]}
    m = one(sets.overlap_measures(left.where("k is not null"), right.where("k is not null"), "k"))
    assert m.jaccard == pytest.approx(0.666667)
    u = sets.union_by_key([left, right], "k", "i").collect()
    assert sorted(r.i for r in u) == [1, 2, 3, 4, 6, 7]
    g = sets.merge_by_key(left, right, "k", "i").collect()
    assert {r.k: r.i for r in g} == {"a": 5, "A ": 2, "b": 3, "c": 6, None: 4}
    assert one(sets.set_hash(left, ["k", "i"])).digest == one(sets.set_hash(left.orderBy(F.desc("i")), ["k", "i"])).digest
    lib = sets.Library(spark)
    lib.set("n", left)
    lib.append("n", right)
    lib.rename("n", "m")
    assert lib.list() == ["m"] and lib.get("m").count() == 7


def test_archive(spark):
    old = spark.createDataFrame([("p", "1", "s1", "{}", "h1", "2024"), ("p", "2", "s2", "{}", "h2", "2024")], "provider string, provider_id string, speciedex_id string, assertion_json string, assertion_hash string, updated_at string")
    new = spark.createDataFrame([("p", "1", "s1", "{1}", "h9", "2025"), ("p", "2", "s2", "{}", "h2", "2025"), ("p", "3", "s3", "{}", "h3", "2025")], old.schema)
    table, events = archive.attach_assertions(old, new)
    assert {r.provider_id: r.assertion_hash for r in table.collect()} == {"1": "h9", "2": "h2", "3": "h3"}
    assert [(r.provider_id, r.previous_assertion_hash) for r in events.collect()] == [("1", "h1")]
    fresh, refused = archive.insert_new(old, new.unionByName(new.where("provider_id = '3'")), "provider_id")
    assert [r.provider_id for r in fresh.collect()] == ["3"] and refused.count() == 3
    syn = spark.createDataFrame([("k1", "s1", "p"), ("k2", "s1", "p"), ("k3", "s2", "p")], "synonym_key string, speciedex_id string, provider string")
    got = archive.replace_synonyms(syn, spark.createDataFrame([("k9", "s1", "p"), ("k9", "s1", "p")], syn.schema))
    assert sorted(r.synonym_key for r in got.collect()) == ["k3", "k9"]
    idx = spark.createDataFrame([("a", "h", "done")], "k string, d string, state string")
    imp = archive.import_records(idx, spark.createDataFrame([("a", "h"), ("b", "h")], "k string, d string"), "k", "d")
    assert {r.k: (r.state, r.event) for r in imp.collect()} == {"a": ("done", "unchanged"), "b": ("pending", "inserted")}


def test_geo(spark):
    df = spark.createDataFrame([(-2.5, 190.0), (2.4, -170.0), (95.0, 0.0)], "lat double, lng double")
    r = df.select(geo.latitude(F.col("lat")).alias("lat"), geo.longitude(F.col("lng")).alias("lng"), geo.round_half_up(F.col("lat")).alias("r")).collect()
    assert [(x.lat, x.lng, x.r) for x in r] == [(-2.5, -170.0, -2), (2.4, -170.0, 2), (None, 0.0, 95)]
    d = one(spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), "km").alias("d"))).d
    assert d == pytest.approx(111.195, abs=0.01)
    b = one(geo.bounds(spark.createDataFrame([(0.0, 170.0), (1.0, -170.0), (2.0, 179.0)], "lat double, lng double")))
    assert (b.west, b.east) == (170.0, -170.0)
    track = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0.0, 0.0), ("a", "2024-01-01 02:00:00", 10.0, 20.0)], "k string, t string, lat double, lng double").withColumn("t", F.col("t").cast("timestamp"))
    at = lambda t: tuple(one(geo.position_at(track, "k", "t", t)))[1:]
    assert at("2024-01-01 01:00:00") == (5.0, 10.0) and at("2023-01-01 00:00:00") == (0.0, 0.0) and at("2025-01-01 00:00:00") == (10.0, 20.0)
    assert one(geo.hex_bins(df.where("lat < 90"), 10.0).agg(F.sum("count")))[0] == 2


def test_graph(spark):
    links = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "y"), ("y", "x")], "node string, up string")
    m = {r.node: (r.depth, r.leaves, r.descendants) for r in graph.tree_metrics(links).collect()}
    assert m["r"] == (0, 2, 3) and m["a"] == (1, 1, 1) and m["x"] == (None, None, None)
    t = {r.node: r.total for r in graph.roll_up(links, spark.createDataFrame([("c", 2.0), ("b", 1.0)], "node string, value double")).collect()}
    assert t == {"r": 3.0, "a": 2.0, "b": 1.0, "c": 2.0}
    inner = spark.createDataFrame([("c", 2.0), ("b", 1.0), ("a", 5.0), ("r", 0.5), ("x", 9.0), ("b", 0.5)], "node string, value double")
    assert {r.node: r.total for r in graph.roll_up(links, inner).collect()} == {"r": 6.0, "a": 5.0, "b": 1.0, "c": 2.0}
    assert graph.roll_up(links.limit(0), inner).count() == 0
    lin = spark.createDataFrame([("id8", "", [("domain", "D"), ("kingdom", "K")])], "id string, source string, lineage array<struct<rank:string,name:string>>")
    e = graph.expand_lineage(lin, "lineage", "source", "id").orderBy("terminal").collect()
    assert e[1].id == "id8" and e[1].parent_id == e[0].id and e[0].parent_id is None and e[0].id.startswith("speciedex:taxon:")


def test_golden_lineage_digest(spark):
    lin = spark.createDataFrame([("x", "", [("domain", "Eukaryota"), ("kingdom", "Animalia")])], "id string, source string, lineage array<struct<rank:string,name:string>>")
    first = one(graph.expand_lineage(lin, "lineage", "source", "id").where("name = 'Eukaryota'"))
    assert first.id.startswith("speciedex:taxon:919a0a728144")


def test_taxonomy(spark):
    def val(c):
        return one(spark.range(1).select(c.alias("x"))).x
    L = F.lit
    assert [val(X.rank(L(r))) for r in ("SSP.", "super kingdom", "Division", "zz")] == ["subspecies", "superkingdom", "phylum", "unranked"]
    assert val(X.canonical_name(L("Panthera leo (Linnaeus, 1758)"), L("(Linnaeus, 1758)"), L("species"))) == "Panthera leo"
    assert val(X.canonical_name(L("Aus bus subsp. cus Smith & Jones, 1900"), L(""), L("ssp."))) == "Aus bus cus"
    assert [val(X.infer_rank(L(n))) for n in ("Aus", "Aus bus", "Aus bus var. cus", "Aus bus cus", "")] == ["genus", "species", "variety", "subspecies", "unranked"]
    assert val(X.without_qualifier(L("Aus bus sensu Smith"))) == "Aus bus" and val(X.authorship(L("A ,B&C"))) == "A, B & C"
    assert val(X.authority_similarity(L("(Smith & Jones, 1900)"), L("(Jones et Smith, 1901)"))) == pytest.approx(0.88)
    assert val(X.text_similarity(L("Aus bus"), L("Aus bus"))) == 1.0 and val(X.text_similarity(L(""), L(None).cast("string"))) == 0.5
    assert val(X.status_similarity(L("valid"), L("accepted"))) == 0.85 and val(X.synonym_confidence(L(5), L("accepted"), L(True), L(True), L(True), L(True))) == pytest.approx(1.0)
    assert val(X.distinct_synonyms(F.array(L("A b"), L("a  B"), L("C"), L("")), L("c"))) == ["A b"]
    assert val(X.rank_neighbour(L("species"), 1)) == "subspecies"


def test_reconcile(spark):
    cols = "speciedex_id string, canonical_name string, scientific_name string, authorship string, rank string, kingdom string, phylum string, class_name string, order_name string, family string, genus string"
    taxa = spark.createDataFrame([("s1", "Aus bus", "Aus bus", "Smith", "species", "Animalia", "", "", "", "", ""), ("s2", "Cus dus", "Cus dus", "", "species", "Plantae", "", "", "", "", ""), ("s3", "Eus fus", "Eus fus", "X", "species", "Fungi", "", "", "", "", ""), ("s4", "Eus fus", "Eus fus", "X", "species", "Fungi", "", "", "", "", "")], cols)
    new = spark.createDataFrame([("gbif", "1", "Aus bus", "Aus bus", "Smith", "species", "Animalia"), ("gbif", "2", "Cus dus", "Cus dus", "Jones", "species", "Plantae"), ("gbif", "3", "Eus fus", "Eus fus", "X", "species", "Fungi"), ("gbif", "4", "New one", "New one", "", "species", "Fungi"), ("gbif", "5", "Zus", "Zus", "", "genus", "Fungi")],
        "provider string, provider_id string, canonical_name string, scientific_name string, authorship string, rank string, kingdom string").selectExpr("*", "'' phylum", "'' class_name", "'' order_name", "'' family", "'' genus", "'' accepted_provider_id")
    sid = spark.createDataFrame([("gbif", "5", "s9")], "provider string, provider_id string, speciedex_id string")
    got = {r.provider_id: (r.action, r.speciedex_id, r.score) for r in resolve.reconcile(new, taxa, sid, {"gbif": 0.98}).collect()}
    assert got == {"1": ("match", "s1", 86.24), "2": ("conflict", None, 66.64), "3": ("conflict", None, 86.24), "4": ("create", None, None), "5": ("match", "s9", None)}


def test_identity_keys_of_every_name(spark, tmp_path):
    from arborlake.plans.core_queries import QUERIES

    names = ["Äus  ÉLEGANS", "ΑΣ ΣΑΣ", "Straße", "×Aus bus", "\u00a0Aus", "Aus\u2003bus", " A\t\nb ", "Жук Ель", "A\u030a", "ﬁlum", "ÅNGSTRÖM", "", None]
    rows = [(f"i{n}", v, "Species ", None if n % 2 else "Plantæ") for n, v in enumerate(names)]
    spark.createDataFrame(rows, "speciedex_id string, canonical_name string, rank string, kingdom string").write.parquet(f"{tmp_path}/taxa.parquet")

    def key(v):  # blanks are those of ASCII, as in Java
        return " ".join(x for x in re.split(r"[ \t\n\x0b\f\r]+", v or "") if x).lower()

    want = {(i, "|".join(map(key, v))) for i, *v in rows}
    assert {tuple(r) for r in QUERIES["scl_identity"](spark, str(tmp_path)).collect()} == want


_TAXON = {"speciedex_id": "", "canonical_name": "Aus bus", "scientific_name": "Aus bus L.", "authorship": "L.", "rank": "species", "kingdom": "Animalia", "phylum": "P", "class_name": "C", "order_name": "O", "family": "F", "genus": "Aus", "status": "accepted"}


def _taxa(spark, *changes):
    rows = [tuple((_TAXON | x).values()) for x in changes]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in _TAXON))


def test_duplicates_do_not_depend_on_block_size(spark):
    taxa = _taxa(spark, *[{"speciedex_id": f"i{n}", "authorship": a} for n, a in enumerate(["L.", None, "L. & Mill.", "Mill.", "Linnaeus", "L., 1758"])])
    pairs = {h: sorted(tuple(r) for r in resolve.duplicate_pairs(taxa, hot=h).collect()) for h in (1, 2, 1000)}
    assert len(pairs[1000]) == 15 and pairs[1] == pairs[2] == pairs[1000]


def test_duplicate_candidates_and_support(spark):
    taxa = _taxa(spark, {"speciedex_id": "a"}, {"speciedex_id": "b", "rank": "subspecies"}, {"speciedex_id": "c", "canonical_name": "Aus cus", "scientific_name": "Aus cus L."}, {"speciedex_id": "d", "canonical_name": "Aus dus", "scientific_name": "Aus dus L."}, {"speciedex_id": "e", "canonical_name": "Aus eus", "scientific_name": "Aus eus L."})
    synonyms = spark.createDataFrame([("c", "AUS  bus"), ("d", "old name"), ("e", "Old Name"), ("e", "other")], "speciedex_id string, synonym_key string")
    providers = spark.createDataFrame([("a", "P"), ("a", "q"), ("c", "p"), ("d", "p"), ("e", "p")], "speciedex_id string, provider string")
    got = {(r.a, r.b): r.score for r in resolve.duplicate_pairs(taxa, providers=providers, synonyms=synonyms).collect()}
    # a and b meet by the scientific name, c by its synonym, d and e by a synonym of both
    name = 0.6 * 1 / 3 + 0.15 + 0.25
    full = 0.6 * 2 / 4 + 0.15 + 0.25
    rest = 0.30 * name + 0.08 * full + 0.14 + 0.10 + 0.08 + 0.18 + 0.04
    assert got[("a", "b")] == pytest.approx(0.82 + 0.05 * 0.25, abs=1e-6)
    assert got[("a", "c")] == pytest.approx(rest + 0.05 * 0.5 + 0.03, abs=1e-6)
    assert got[("d", "e")] == pytest.approx(rest + 0.05 + 0.03 * 0.5, abs=1e-6)
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")}
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.7), ("x", "y", 0.99)], "a string, b string, score double")
    assert {r.cluster: (r.size, r.action) for r in resolve.cluster_summary(pairs).collect()} == {"a": (3, "review"), "x": (2, "merge")}


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 60)] + [("z1", "z2"), ("z2", "z3"), ("z1", "z1")], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(61)] + [("z1",), ("z2",), ("z3",), ("lone",)], "node string")
    got = {r.node: r.cluster for r in resolve.components(nodes, edges).collect()}
    assert {c for n, c in got.items() if n.startswith("n")} == {"n000"} and got["z3"] == "z1" and got["lone"] == "lone"


def test_issues(spark):
    df = spark.createDataFrame([("p", "1", " ", "sha")], "provider string, provider_id string, speciedex_id string, assertion_hash string").withColumn("assertion_json", F.lit("{}"))
    assert sorted(r.code for r in resolve.issues(df, ["provider_id"], resolve.assertion_rules()).collect()) == ["assertion_hash_mismatch", "speciedex_id_missing"]


def test_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,,name\n"a ""q"", b",1,\n,,\nx\n')
    got = files.delimited(spark, str(p))
    assert got.columns == ["name", "column2", "name_2"] and sorted(map(tuple, got.collect())) == [('a "q", b', "1", ""), ("x", "", "")]
    j = tmp_path / "d.json"
    j.write_text(json.dumps({"data": {"items": [{"a": 1}, {"a": 2}]}}))
    assert sorted(r.a for r in files.json_document(spark, str(j), "data.items").collect()) == [1, 2]
    t = tmp_path / "t.txt"
    t.write_text("one\ntwo")
    assert [tuple(r) for r in files.text_lines(spark, str(t)).collect()] == [(1, "one"), (2, "two")]
    raw = spark.createDataFrame([('{"id": 1, "n": {"x": " Aus "}}',), ('{"id": 2}',), ("bad",), ('{"id": 3, "n": {"x": "skip"}}',)], "value string")
    good, bad = files.mapped(raw, {"mapping": {"provider_id": "id", "scientific_name": {"path": "n.x", "transforms": ["lower"]}}, "defaults": {"rank": "species"}, "computed": {"url": "http://h/{id}"}, "required": ["provider_id", "scientific_name"], "filters": [{"field": "scientific_name", "op": "not_equals", "value": "skip"}]})
    assert [tuple(r) for r in good.collect()] == [("1", "aus", "species", "http://h/1")] and sorted(r.reason for r in bad.collect()) == ["invalid", "missing scientific_name"]


META = """<archive xmlns="http://rs.tdwg.org/dwc/text/"><core rowType="http://x/Taxon" fieldsTerminatedBy="\\t" fieldsEnclosedBy="" ignoreHeaderLines="1"><files><location>taxa.tsv</location></files><id index="0"/><field index="1" term="http://x/scientificName"/><field index="2" term="http://x/rank" default="species"/></core>
<extension rowType="http://x/VernacularName" fieldsTerminatedBy="," ignoreHeaderLines="0"><files><location>names.csv</location></files><coreid index="0"/><field index="1" term="http://x/name"/></extension></archive>"""


def test_star_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("meta.xml", META)
        z.writestr("taxa.tsv", "id\tname\trank\n1\tAus\tgenus\n2\tBus bus\t\n")
        z.writestr("names.csv", "1,aa\n1,bb\n")
    folder = files.unpack(str(tmp_path / "a.zip"), str(tmp_path / "x"))
    got = {r._id: r for r in files.star_archive(spark, folder).collect()}
    assert got["2"]["rank"] == "species" and got["2"].extensions is None and [json.loads(x)["name"] for x in got["1"].extensions["VernacularName"]] == ["aa", "bb"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    sinks.write_volumes(df, str(tmp_path / "v"), per_file=1, order=["i"])
    m = sinks.file_digests(spark, str(tmp_path / "v")).where("path like '%.json'")
    assert m.count() >= 2 and sinks.verify_files(spark, str(tmp_path / "v"), m).where("problem = 'changed'").count() == 0
    sinks.write_csv(df, str(tmp_path / "c"), order=["i"], limit=1, always_quote=True)
    text = "".join(open(tmp_path / "c" / f, newline="").read() for f in os.listdir(tmp_path / "c") if f.endswith(".csv"))
    assert text == '"i","s"\r\n"1","a"\r\n'
    assert sinks.table_text(df.orderBy("i")).splitlines()[2] == "| 1 | a |"
    assert [r.line for r in sinks.prometheus(df.where("i = 1"), "n", "i", ["s"]).collect()] == ['n{s="a"} 1']


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.createDataFrame([("k1", 1, '{"a":1}'), ("k2", 2, "plain")], "k string, n int, m string")
    df.coalesce(1).write.parquet(src)
    each = streams.upsert_batches(str(tmp_path / "out"), ["k"], ["n"])
    run = lambda: streams.run_available(streams.parquet_stream(spark, src, df.schema), str(tmp_path / "cp"), each)
    run()
    df.where("k = 'k1'").withColumn("n", F.lit(9)).coalesce(1).write.mode("append").parquet(src)
    run()
    assert {r.k: r.n for r in streams.latest_version(spark, str(tmp_path / "out")).collect()} == {"k1": 9, "k2": 2}
    assert sorted((r.kind, r.record) for r in streams.ingest(df, "m", [F.col("n") > 0]).collect()) == [("json", '{"a":1}'), ("raw", '{"raw":"plain"}')]


def test_summaries_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, None), (None, 2.0, " ")], "k string, v double, s string")
    assert {(r.key, r.records, r.rows) for r in summaries.group_records(df, "k", "v").collect()} == {("a", 1.0, 2), ("unknown", 2.0, 1)}
    assert {(r.field, r.nulls, r.scalars) for r in summaries.cell_counts(df).collect()} == {("k", 1, 2), ("v", 1, 2), ("s", 1, 2)}
    assert summaries.missing(df, df.limit(0), ["k", "s"]).count() == 3 and summaries.missing(df, df, ["k", "s"]).count() == 0
    assert [r.k for r in summaries.grid_filter(df, "X", ["s"]).collect()] == ["a"] and summaries.grid_filter(df, " ", ["s"]).count() == 3
    assert summaries.index_filter(df, {"v": {"$ne": 1}}).count() == 2 and summaries.index_filter(df, {"k": ["A"], "v": {"$gte": 1, "$odd": 3}}).count() == 1
    b = one(summaries.chart_bounds(df.where("v is null"), "v"))
    assert (b.low, b.high) == (-1.0, 1.0)
    with pytest.raises(ValueError):
        summaries.table_counts({"x": df}, ["y"])
    runs = one(summaries.run_summary(spark.createDataFrame([("p", 0, 0, 0, 0, 0, 0)], "p string, fetched int, created int, matched int, revised int, conflicted int, rejected int"), "p"))
    assert runs.acceptance is None and runs.error_rate is None
    where = spark.createDataFrame([('{"lat": 95, "lng": 1}',), ("no json",), (None,), ('{"geometry": {"coordinates": [3, 4]}}',)], "j string").select(*summaries.point_of("j")).collect()
    assert [tuple(r) for r in where] == [(None, None)] * 3 + [(4.0, 3.0)]


def test_names_by_words(spark):
    rows = [("Aus bus Smith, 1900", ""), ("Aus bus (L. & M.) Jones", ""), ("Aus bus cf. cus", ""), ("Aus Smith", ""), ("Aus bus van Berg", ""), ("", ""), (None, None), ("Aus bus L.", "L."), ("cf.", "")]
    got = spark.createDataFrame(rows, "n string, a string").select(X.without_author(F.col("n"), F.col("a")).alias("x")).collect()
    assert [r.x for r in got] == ["Aus bus", "Aus bus", "Aus bus", "Aus Smith", "Aus bus van", "", "", "Aus bus", "cf."]
    years = spark.createDataFrame([("Smith, 1758a",), ("[1999] 2000",), ("12345",), (None,), ("1499",)], "a string").select(X.year_of(F.col("a")).alias("y")).collect()
    assert [r.y for r in years] == [1758, 1999, None, None, None]


def test_repeated_keys_choose_the_newest_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "n")], "k string, loaded_at int, v string")
    for n in (1, 3):
        assert {(r.k, r.v) for r in archive.newest(df.repartition(n), ["k"]).collect()} == {("a", "z"), (None, "n")}


def test_quantiles_match_the_gathering_aggregate(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "one"]), rng.choice([None, 1.0, 2.0, rng.random()])) for _ in range(400)] + [("single", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = (0.0, 0.1, 0.5, 0.95, 1.0)
    want = {r.k: r.c for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("c")).collect() if r.c}
    got = {r.k: r.cuts for r in stats.quantiles(df.repartition(5), ["k"], "v", points).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert one(stats.quantiles(df, [], "v", (0.5,))).cuts == pytest.approx([one(df.agg(F.percentile("v", F.lit(0.5)).alias("m"))).m])
    assert stats.quantiles(df.limit(0), ["k"], "v", points).count() == 0


def test_trailing_counts_across_chunks(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(4000) / 2) for i in range(500)] + [(900, "a", None), (901, "a", None)]
    df = spark.createDataFrame(rows, "i int, k string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.trailing for r in timeline.trailing_counts(df, "ts", 7, "k").collect()}
    for i, k, s in rows:
        assert got[i] == sum(1 for _, kk, x in rows if kk == k and (x is None if s is None else x is not None and s - 7 <= x <= s))
    assert len(got) == len(rows)
