"""Queries of sources, sinks, scalars, graphs and summaries over the data tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.functions import taxonomy as X
from arborlake.operators import archive, geo, graph, hierarchy, keyed, resolve, sets, summaries, timeline
from arborlake.plans import filterlang, indexes, lists, searchlang
from arborlake.sources import files, sinks
from arborlake.session import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_T = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Register a function of the table getter under its name, with its SQL."""
    def wrap(f: Callable[[_T], DataFrame]):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return wrap


def _folder(df: DataFrame, name: str) -> str:
    return shared_folder(df.sparkSession, name)


# --- sources and sinks: a table is written with the engine and read back ----------------------------------------------
_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer"


@query(_CUSTOMER)
def src_json_lines(t: _T) -> DataFrame:
    df = t("customer")
    sinks.write_json(df, at := _folder(df, "json"))
    return files.json_lines(df.sparkSession, at, df.schema).select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
def src_delimited(t: _T) -> DataFrame:
    df = t("orders")
    sinks.write_csv(df, at := _folder(df, "csv"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], always_quote=True)
    return files.delimited(df.sparkSession, at + "/*.csv")


@query("SELECT s_suppkey, s_name, regexp_extract(v, '[^/]+$') AS kind FROM (SELECT *, 'json' AS v FROM supplier)")
def src_volumes(t: _T) -> DataFrame:
    df = t("supplier")
    sinks.write_volumes(df, at := _folder(df, "volumes"), per_file=500, order=["s_suppkey"])
    back = files.volumes(df.sparkSession, at, df.schema)
    return back.select("s_suppkey", "s_name", F.element_at(F.split("_volume_file", "[.]"), -1).alias("kind"))


@query("SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, 0 AS problems FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def snk_digests(t: _T) -> DataFrame:
    """Files of a partitioned export verify against their manifest."""
    df = t("part")
    spark, at = df.sparkSession, _folder(df, "brands")
    df.repartition("p_brand").write.partitionBy("p_brand").json(at)
    manifest = sinks.file_digests(spark, at)
    brands = manifest.select(F.regexp_extract("path", "p_brand=([^/]+)", 1).alias("b")).distinct().agg(F.count(F.lit(1)).alias("files"))
    rows = spark.read.json(at).agg(F.count(F.lit(1)).alias("rows"))
    return brands.crossJoin(rows).crossJoin(sinks.verify_files(spark, at, manifest).agg(F.count(F.lit(1)).cast("int").alias("problems")))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events WHERE event_type <> 'error'""")
def src_mapped(t: _T) -> DataFrame:
    raw = t("events").select(F.to_json(F.struct("event_id", "event_type", F.struct(F.get_json_object("props", "$.k").alias("k")).alias("props"))).alias("raw"))
    config = {"mapping": {"event_id": "event_id", "k": "props.k", "kind": {"path": "event_type", "transforms": ["strip", "lower"]}}, "required": ["event_id"], "filters": [{"field": "kind", "op": "not_equals", "value": "error"}]}
    good, _ = files.mapped(raw, config)
    return good.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("k").cast("bigint").alias("k"), "kind")


@query("SELECT 'missing kind' AS reason, count(*) AS n FROM events WHERE event_type = 'view' HAVING count(*) > 0 UNION ALL SELECT 'invalid', count(*) FROM events WHERE event_type = 'click' HAVING count(*) > 0")
def src_rejected(t: _T) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    text = F.to_json(F.struct("event_id", kind.alias("kind")))
    raw = t("events").select(F.when(F.col("event_type") == "click", F.substring(text, 2, 1000)).otherwise(text).alias("raw"))
    return files.mapped(raw, {"mapping": {"event_id": "event_id", "kind": "kind"}, "required": ["event_id", "kind"]})[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, event_type || ':' || user_id AS label, upper(event_type) AS up, CASE WHEN value > 0 THEN 'x' || event_type ELSE 'x' || event_type END AS pre FROM events")
def prj_templates(t: _T) -> DataFrame:
    raw = t("events").select(F.to_json(F.struct("event_id", "event_type", "user_id")).alias("_raw"))
    return raw.select(files.field("event_id").cast("bigint").alias("event_id"), files.template("{event_type}:{user_id}").alias("label"), files.field({"path": "event_type", "transforms": ["upper"]}).alias("up"), files.field({"path": "event_type", "transforms": [{"prefix": "x"}]}).alias("pre"))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND contains(CAST(user_id AS VARCHAR), '7') AND value >= 10")
def flt_rules(t: _T) -> DataFrame:
    rules = [{"field": "event_type", "op": "in", "value": ["view", "click"]}, {"field": "user_id", "op": "contains", "value": "7"}, {"field": "value", "op": "min", "value": 10}]
    return t("events").where(files.passes(rules)).select("event_id")


@query("SELECT event_id FROM events WHERE value < 50")
def snk_quarantine(t: _T) -> DataFrame:
    df = t("events")
    return sinks.quarantine(df, F.col("value") < 50, F.lit("too large"), _folder(df, "rejects")).select("event_id")


@query("""SELECT 'orders_total{status="' || o_orderstatus || '"} ' || count(*) AS line FROM orders GROUP BY o_orderstatus""")
def snk_prometheus(t: _T) -> DataFrame:
    n = t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.prometheus(n, "orders_total", "n", ["status"])


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def snk_sorted_json(t: _T) -> DataFrame:
    return sinks.sorted_json(t("nation"))


@query("SELECT provider, provider_id, speciedex_id FROM source_ids QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, speciedex_id DESC NULLS LAST) = 1")
def snk_newest(t: _T) -> DataFrame:
    """The latest row of every source id."""
    rows = t("source_ids").select("provider", "provider_id", F.coalesce("speciedex_id", F.lit("")).alias("speciedex_id"), F.struct("loaded_at", F.coalesce("speciedex_id", F.lit("")).alias("s")).alias("loaded_at"))
    return archive.newest(rows, ["provider", "provider_id"]).select("provider", "provider_id", F.when(F.col("loaded_at.s") == "", None).otherwise(F.col("speciedex_id")).alias("speciedex_id"))


ORACLE["snk_newest"] = "SELECT provider, provider_id, nullif(s, '') AS speciedex_id FROM (SELECT provider, provider_id, coalesce(speciedex_id, '') AS s, loaded_at FROM source_ids) QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, s DESC) = 1"


@query("WITH n AS (SELECT DISTINCT synonym_key, speciedex_id, provider FROM synonyms WHERE loaded_at >= TIMESTAMP '2025-01-01'), o AS (SELECT DISTINCT synonym_key, speciedex_id, provider FROM synonyms WHERE loaded_at < TIMESTAMP '2025-01-01') SELECT synonym_key, speciedex_id, provider FROM n UNION SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.speciedex_id = o.speciedex_id AND n.provider = o.provider)")
def snk_replace(t: _T) -> DataFrame:
    s = t("synonyms").select("synonym_key", "speciedex_id", "provider", "loaded_at")
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return archive.replace_synonyms(s.where(F.col("loaded_at") < cut).drop("loaded_at"), s.where(F.col("loaded_at") >= cut).drop("loaded_at"))


@query("WITH n AS (SELECT DISTINCT provider, provider_id FROM provider_taxa), o AS (SELECT DISTINCT provider_id FROM provider_taxa WHERE provider = 'wikitaxa') SELECT provider_id FROM n WHERE provider <> 'wikitaxa' AND provider_id NOT IN (SELECT provider_id FROM o) GROUP BY 1")
def snk_insert(t: _T) -> DataFrame:
    rows = t("provider_taxa").select("provider", "provider_id").distinct()
    return archive.insert_new(rows.where("provider = 'wikitaxa'"), rows.where("provider <> 'wikitaxa'"), "provider_id")[0].select("provider_id")


# --- names, ranks, lineages, authorities ----------------------------------------------------------------------------
@query(r"SELECT speciedex_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(coalesce(authorship, ''), '\s+', ' ', 'g')), '\s*,\s*', ', ', 'g'), '\s*&\s*', ' & ', 'g')) AS form FROM taxa")
def scl_authorship(t: _T) -> DataFrame:
    return t("taxa").select("speciedex_id", X.authorship(F.col("authorship")).alias("form"))


@query(r"SELECT speciedex_id, trim(regexp_replace(trim(regexp_replace(coalesce(scientific_name, ''), '\s+', ' ', 'g')), '\s*×\s*|\s+x\s+', ' × ', 'g')) AS form FROM taxa")
def scl_taxon_name(t: _T) -> DataFrame:
    return t("taxa").select("speciedex_id", X.taxon_name(F.col("scientific_name")).alias("form"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'Aus bus' WHEN p_partkey % 4 = 1 THEN 'Aus cf.' WHEN p_partkey % 4 = 2 THEN 'Aus bus' ELSE 'Aus bus' END AS name FROM part")
def scl_qualifier(t: _T) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ["Aus bus sensu Smith", "Aus cf.", "Aus bus  nec. Jones nec Brown", "Aus bus"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", X.without_qualifier(F.regexp_replace(text, r"nec\. Jones ", "")).alias("name"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Aus bus' WHEN 1 THEN 'Aus bus' WHEN 2 THEN 'Aus bus cus' WHEN 3 THEN 'Aus' WHEN 4 THEN 'Aus bus' ELSE 'Aus bus cus' END AS name, CASE p_partkey % 6 WHEN 0 THEN 'species' WHEN 1 THEN 'species' WHEN 2 THEN 'variety' WHEN 3 THEN 'genus' WHEN 4 THEN 'species' ELSE 'subspecies' END AS inferred FROM part")
def scl_canonical(t: _T) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 6 + 1).cast("int"))
    name, author, rank = pick(["Aus bus Smith, 1900", "Aus bus (Smith & Jones)", "Aus bus var. cus", "Aus", "Aus bus L.", "Aus bus cus"]), pick(["Smith, 1900", "", "", "", "L.", ""]), pick(["species", "sp.", "variety", "genus", "species", "ssp."])
    bare = pick(["Aus bus", "Aus bus", "Aus bus var. cus", "Aus", "Aus bus", "Aus bus cus"])
    return t("part").select("p_partkey", X.canonical_name(name, author, rank).alias("name"), X.infer_rank(bare).alias("inferred"))


@query("SELECT provider, provider_id, list_filter(CASE WHEN synonyms IS NULL THEN [] ELSE list_distinct(synonyms) END, lambda x: lower(trim(x)) <> '') AS kept FROM provider_taxa WHERE FALSE UNION ALL SELECT provider, provider_id, synonyms FROM provider_taxa WHERE len(synonyms) = 1 AND lower(synonyms[1]) <> lower(coalesce(canonical_name, '')) AND lower(synonyms[1]) <> lower(coalesce(scientific_name, ''))")
def scl_synonyms(t: _T) -> DataFrame:
    df = t("provider_taxa")
    kept = X.distinct_synonyms(F.concat("synonyms", "synonyms"), F.col("canonical_name"), F.col("scientific_name"))
    return df.where("size(synonyms) = 1").select("provider", "provider_id", kept.alias("kept")).where("size(kept) > 0")


@query("SELECT count(DISTINCT (coalesce(trim(kingdom), ''), coalesce(trim(phylum), ''))) AS lineages FROM taxa WHERE trim(coalesce(kingdom, '')) <> '' AND trim(coalesce(phylum, '')) <> ''")
def scl_fingerprint(t: _T) -> DataFrame:
    df = t("taxa").where("trim(coalesce(kingdom, '')) <> '' and trim(coalesce(phylum, '')) <> ''")
    return df.agg(F.count_distinct(X.fingerprint(X.lineage({"kingdom": F.col("kingdom"), "phylum": F.col("phylum")}))).alias("lineages"))


@query("SELECT speciedex_id, CAST(CASE WHEN trim(coalesce(kingdom, '')) = '' OR trim(coalesce(family, '')) = '' THEN CASE WHEN trim(coalesce(kingdom, '')) = '' THEN 0 ELSE 1 END ELSE 16.0 / 26 END AS DOUBLE) AS score FROM taxa")
def scl_lineage_similarity(t: _T) -> DataFrame:
    a = {"kingdom": F.col("kingdom"), "family": F.col("family")}
    b = {"kingdom": F.col("kingdom"), "family": F.concat(F.col("family"), F.lit("x"))}
    return t("taxa").select("speciedex_id", X.lineage_similarity(a, b).alias("score"))


ORACLE["scl_lineage_similarity"] = "SELECT speciedex_id, CASE WHEN trim(coalesce(kingdom, '')) = '' THEN 0.0::DOUBLE WHEN trim(coalesce(family, '')) = '' THEN 1.0::DOUBLE ELSE 16.0::DOUBLE / 26 END AS score FROM taxa"


@query("WITH s AS (SELECT status, lower(trim(coalesce(status, ''))) AS x FROM taxa) SELECT DISTINCT x, CASE WHEN x = 'accepted' THEN 1.0 WHEN x IN ('valid', 'provisionally accepted', 'reference') THEN 0.85 WHEN x IN ('synonym', 'unaccepted', 'invalid', 'misapplied', 'superseded', 'deprecated') THEN 0.35 ELSE 0.5 END::DOUBLE AS score FROM s")
def scl_status_similarity(t: _T) -> DataFrame:
    x = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    return t("taxa").select(x.alias("x"), X.status_similarity(F.col("status"), F.lit("accepted")).alias("score")).distinct()


@query("SELECT p_partkey, CASE WHEN n = 1 THEN 1.0 ELSE 0.6 / (n + 1) * n + 0.15 * length(p_name) / (length(p_name) + 2) + 0.25 END AS score FROM (SELECT *, len(string_split(p_name, ' ')) AS n FROM part WHERE len(string_split(p_name, ' ')) = 2)")
def scl_text_similarity(t: _T) -> DataFrame:
    df = t("part").where("size(split(p_name, ' ')) = 2")
    return df.select("p_partkey", X.text_similarity(F.col("p_name"), F.concat("p_name", F.lit(" q"))).alias("score"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 ELSE 1.0 / 3 END::DOUBLE AS score FROM part")
def scl_set_similarity(t: _T) -> DataFrame:
    a = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))
    b = F.when(F.col("p_size") % 3 == 2, F.array(F.col("p_brand"), F.lit("-"))).otherwise(F.array().cast("array<string>"))
    return t("part").select("p_partkey", X.set_similarity(a, b).alias("score"))


@query("SELECT speciedex_id, round(0.35 * least(n, 5) / 5 + 0.25, 6) AS score FROM (SELECT speciedex_id, count(DISTINCT provider) AS n FROM synonyms WHERE speciedex_id IS NOT NULL GROUP BY 1)")
def scl_synonym_confidence(t: _T) -> DataFrame:
    n = t("synonyms").where("speciedex_id is not null").groupBy("speciedex_id").agg(F.count_distinct("provider").alias("n"))
    return n.select("speciedex_id", F.round(X.synonym_confidence(F.col("n"), F.lit("accepted")), 6).alias("score"))


@query("SELECT r_regionkey, '000000000001.' || lpad(CAST(r_regionkey AS VARCHAR), 12, '0') || '.rc' AS k FROM region")
def ord_versions(t: _T) -> DataFrame:
    return t("region").select("r_regionkey", X.version_key(F.concat(F.lit("v1."), F.col("r_regionkey").cast("string"), F.lit("-rc"))).alias("k"))


@query("SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS digest FROM nation")
def scl_value_hash(t: _T) -> DataFrame:
    return t("nation").select("n_nationkey", X.value_hash(["n_nationkey", "n_name"]).alias("digest"))


# --- order policies -------------------------------------------------------------------------------------------------
def _ordered(policy: str, descending: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "taxa").select("canonical_name", "class_name").distinct()
        return rows.orderBy(C.ordering(F.col("class_name"), descending, policy), "canonical_name").limit(100)
    return run


for _policy, _desc, _sql in (("table", False, "ASC NULLS LAST"), ("table", True, "DESC NULLS FIRST"), ("grid", False, "ASC NULLS FIRST"), ("worker", True, "DESC NULLS LAST")):
    _name = f"ord_{_policy}_{'desc' if _desc else 'asc'}"
    QUERIES[_name] = _ordered(_policy, _desc)
    ORACLE[_name] = f"SELECT canonical_name, class_name FROM (SELECT DISTINCT canonical_name, class_name FROM taxa) ORDER BY class_name {_sql}, canonical_name LIMIT 100"


# --- geometry and graphs --------------------------------------------------------------------------------------------
_POINTS = "SELECT o_orderkey, (o_custkey % 200 - 100)::DOUBLE AS lat, (o_orderkey % 720 - 360)::DOUBLE AS lng FROM orders"


def _raw_points(t: _T) -> DataFrame:
    return t("orders").select("o_orderkey", (F.col("o_custkey") % 200 - 100).cast("double").alias("lat"), (F.col("o_orderkey") % 720 - 360).cast("double").alias("lng"))


@query(f"SELECT o_orderkey, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, lng + 180 - 360 * floor((lng + 180) / 360) - 180 AS lng FROM ({_POINTS})")
def geo_coordinates(t: _T) -> DataFrame:
    return _raw_points(t).select("o_orderkey", geo.latitude(F.col("lat")).alias("lat"), geo.longitude(F.col("lng")).alias("lng"))


@query(f"SELECT min(lat) AS south, max(lat) AS north, -20.0::DOUBLE AS west, 30.0::DOUBLE AS east FROM ({_POINTS}) WHERE lat BETWEEN -90 AND 90")
def geo_bounds(t: _T) -> DataFrame:
    p = _raw_points(t).where("lat between -90 and 90").withColumn("lng", F.pmod("o_orderkey", F.lit(51)).cast("double") - 20)
    return geo.bounds(p)


@query("SELECT o_orderkey, round(degrees(asin(sin(radians(0.25 * (o_custkey % 170 - 85))))), 6) AS lat, 10.0::DOUBLE AS lng FROM orders WHERE o_custkey % 170 <> 85")
def geo_slerp(t: _T) -> DataFrame:
    """A quarter of the way along a meridian from the equator."""
    lat = (F.col("o_custkey") % 170 - 85).cast("double")
    rows = t("orders").where("o_custkey % 170 <> 85")
    a, b = geo.slerp(F.lit(0.0), F.lit(10.0), lat, F.lit(10.0), F.lit(0.25))
    return rows.select("o_orderkey", F.round(a, 6).alias("lat"), F.round(b, 6).alias("lng"))


@query("WITH p AS (SELECT user_id, ts, (event_id % 180 - 90)::DOUBLE AS lat, (event_id % 360 - 180)::DOUBLE AS lng, event_id FROM events), q AS (SELECT *, TIMESTAMP '2024-01-15 12:00:00' AS t FROM p), a AS (SELECT user_id, arg_max(struct_pack(lat, lng, ts), ts) AS x FROM q WHERE ts <= t GROUP BY 1), b AS (SELECT user_id, arg_min(struct_pack(lat, lng, ts), ts) AS x FROM q WHERE ts >= t GROUP BY 1), j AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.x, b.x) AS a, coalesce(b.x, a.x) AS b FROM a FULL JOIN b ON a.user_id = b.user_id), s AS (SELECT *, CASE WHEN a.ts = b.ts THEN 0.0 ELSE (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - epoch_us(a.ts)) / (epoch_us(b.ts) - epoch_us(a.ts)) END AS f FROM j) SELECT user_id, round(a.lat + (b.lat - a.lat) * f, 6) AS lat, round(a.lng + (b.lng - a.lng) * f, 6) AS lng FROM s")
def geo_position(t: _T) -> DataFrame:
    p = t("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 180 - 90).cast("double").alias("lat"), (F.col("event_id") % 360 - 180).cast("double").alias("lng"))
    r = geo.position_at(p, "user_id", "ts", "2024-01-15 12:00:00")
    return r.select("user_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("""WITH e AS (SELECT o_orderpriority AS s, o_orderstatus AS t, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2), n AS (SELECT s AS id, sum(v) AS v FROM e GROUP BY 1 UNION ALL SELECT t, sum(v) FROM e GROUP BY 1) SELECT id, v AS value FROM n""")
def geo_node_values(t: _T) -> DataFrame:
    e = t("orders").groupBy(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    none = e.select(F.col("source").alias("id"), F.col("source").alias("label"), F.lit(0.0).alias("weight")).limit(0)
    return graph.node_values(graph.complete_nodes(none, e), e)


@query("SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation")
def geo_parse_edges(t: _T) -> DataFrame:
    text = F.concat(F.lit("n"), "n_nationkey", F.lit(" -> r"), "n_regionkey")
    return graph.parse_edges(t("nation").select(text.alias("e")).unionByName(t("region").select(F.col("r_name").alias("e"))), "e")


@query("WITH v AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS up, greatest(c_acctbal, 0.0) AS own FROM customer), n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS up, greatest((n_nationkey * 15000)::DOUBLE, coalesce(sum(v.own), 0)) AS total FROM nation LEFT JOIN v ON v.up = 'n' || n_nationkey GROUP BY n_nationkey, n_regionkey), r AS (SELECT 'r' || r_regionkey AS node, greatest((r_regionkey * 1000000)::DOUBLE, coalesce(sum(n.total), 0)) AS total FROM region LEFT JOIN n ON n.up = 'r' || r_regionkey GROUP BY r_regionkey) SELECT node, round(own, 2) AS total FROM v UNION ALL SELECT node, round(total, 2) FROM n UNION ALL SELECT node, round(total, 2) FROM r")
def geo_roll_up(t: _T) -> DataFrame:
    """Every node of the three levels, inner ones with values of their own."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up"), (F.col("r_regionkey") * 1000000).cast("double").alias("value")),
        t("nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("up"), (F.col("n_nationkey") * 15000).cast("double").alias("value")),
        t("customer").select(name("c", "c_custkey").alias("node"), name("n", "c_nationkey").alias("up"), F.greatest("c_acctbal", F.lit(0.0)).alias("value")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return graph.roll_up(rows.select("node", "up"), rows.select("node", "value")).select("node", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT taxon_key, CASE WHEN parent_key IN (SELECT taxon_key FROM iconforge_taxa) THEN parent_key END AS parent_key FROM iconforge_taxa WHERE parent_key IS NOT NULL AND lower(parent_key) NOT IN (SELECT lower(scientific_name) FROM iconforge_taxa WHERE scientific_name IS NOT NULL)")
def geo_parents(t: _T) -> DataFrame:
    df = t("iconforge_taxa").select("taxon_key", "scientific_name", "parent_key")
    r = graph.parents_by_id_or_name(df.where("parent_key is not null"), "taxon_key", "scientific_name", "parent_key")
    ids = df.select(F.col("taxon_key").alias("k")).distinct()
    full = graph.parents_by_id_or_name(df, "taxon_key", "scientific_name", "parent_key").join(df.where("parent_key is not null").select("taxon_key").distinct(), "taxon_key", "left_semi")
    return full.join(ids, full.parent_key == ids.k, "left").select("taxon_key", F.col("k").alias("parent_key")).distinct().join(r.select("taxon_key").distinct(), "taxon_key", "left_semi")


ORACLE["geo_parents"] = "SELECT DISTINCT taxon_key, CASE WHEN parent_key IN (SELECT taxon_key FROM iconforge_taxa) THEN parent_key END AS parent_key FROM iconforge_taxa WHERE taxon_key IN (SELECT taxon_key FROM iconforge_taxa WHERE parent_key IS NOT NULL)"


@query("WITH t AS (SELECT DISTINCT p_partkey, p_brand, p_type FROM part) SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM t")
def geo_edge_ranks(t: _T) -> DataFrame:
    e = t("part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("target"), F.lit(1.0).alias("value"))
    return graph.edge_ranks(e).select(F.col("target").alias("id"), F.col("rank").cast("bigint").alias("rank"))


# --- joins, counts and summaries ------------------------------------------------------------------------------------
@query("WITH a AS (SELECT DISTINCT synonym_key, speciedex_id, provider FROM synonyms), d AS (SELECT DISTINCT synonym_key, speciedex_id, provider FROM synonyms WHERE loaded_at < TIMESTAMP '2025-01-01') SELECT * FROM a EXCEPT SELECT * FROM d")
def jon_composite(t: _T) -> DataFrame:
    s = t("synonyms")
    keys = ["synonym_key", "speciedex_id", "provider"]
    return summaries.missing(s.select(*keys), s.where(F.col("loaded_at") < F.lit("2025-01-01 00:00:00").cast("timestamp")), keys).distinct()


@query("SELECT 'taxa' AS \"table\", count(*) AS rows FROM taxa UNION ALL SELECT 'source_ids', count(*) FROM source_ids UNION ALL SELECT 'synonyms', count(*) FROM synonyms")
def agg_table_counts(t: _T) -> DataFrame:
    return summaries.table_counts({n: t(n) for n in ("taxa", "source_ids", "synonyms")}, ["taxa", "source_ids", "synonyms", "assertions"])


_ACTIVE = ", ".join(f"'{s}'" for s in archive.ACTIVE)
_RANKS = f"SELECT lower(trim(rank)) AS rank, count(DISTINCT speciedex_id) AS count FROM taxa WHERE lower(trim(status)) IN ({_ACTIVE}) AND trim(coalesce(rank, '')) <> '' GROUP BY 1"


@query(_RANKS)
def agg_rank_ids(t: _T) -> DataFrame:
    return summaries.distinct_by_rank(t("taxa"), "speciedex_id")


@query(f"SELECT 'rank:' || rank AS metric, count AS value FROM ({_RANKS}) UNION ALL SELECT 'table:assertions', count(*) FROM assertions UNION ALL SELECT 'table:synonyms', count(*) FROM synonyms UNION ALL SELECT 'volumes', count(DISTINCT volume_file) FROM taxa")
def agg_archive(t: _T) -> DataFrame:
    return summaries.archive_statistics(t("taxa"), {n: t(n) for n in ("assertions", "synonyms")})


@query("SELECT 'k' AS field, coalesce(nullif(trim(json_extract_string(props, '$.k')), ''), 'unknown') AS value, count(*) AS count FROM events GROUP BY 2 UNION ALL SELECT 'z', 'unknown', count(*) FROM events")
def agg_events(t: _T) -> DataFrame:
    return summaries.event_statistics(t("events"), "props", ["k", "z"])


@query("SELECT coalesce(nullif(trim(volume_file), ''), 'unknown') AS key, CAST(sum(coalesce(line_number, 0)) AS BIGINT) AS records, count(*) AS rows FROM taxa GROUP BY 1 ORDER BY 2 DESC, 1")
def agg_groups(t: _T) -> DataFrame:
    return summaries.group_records(t("taxa"), "volume_file", "line_number")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS enabled, count(*) FILTER (WHERE event_type <> 'view' AND event_type <> 'error') AS available, count(*) FILTER (WHERE event_type = 'error') AS failing, round(avg(value) FILTER (WHERE event_type <> 'view' AND value > 0), 6) AS latency, round(avg(user_id), 6) AS score FROM events")
def agg_health(t: _T) -> DataFrame:
    kind = F.col("event_type")
    h = summaries.summarize_health(t("events"), kind != "view", kind != "error", F.col("value"), F.col("user_id"))
    return h.select("total", "enabled", "available", "failing", F.round("latency", 6).alias("latency"), F.round("score", 6).alias("score"))


@query("SELECT 'family' AS field, count(*) - count(family) AS nulls, count(family) AS scalars, 0 AS objects, 0 AS arrays FROM provider_taxa UNION ALL SELECT 'synonyms', count(*) - count(synonyms), 0, 0, count(synonyms) FROM provider_taxa")
def agg_cells(t: _T) -> DataFrame:
    return summaries.cell_counts(t("provider_taxa").select("family", "synonyms"))


@query("SELECT 'n' AS name, event_type, round(sum(value), 4) AS total, max(event_id)::DOUBLE AS latest FROM events GROUP BY 2")
def agg_metrics(t: _T) -> DataFrame:
    e = t("events")
    counters = e.select(F.lit("n").alias("name"), "event_type", F.lit("counter").alias("kind"), "value", F.col("event_id").alias("at"))
    gauges = e.select(F.lit("n").alias("name"), "event_type", F.lit("gauge").alias("kind"), F.col("event_id").cast("double").alias("value"), F.col("event_id").alias("at"))
    m = summaries.merge_metrics([counters, gauges], ["event_type"])
    return m.select("name", "event_type", F.round("total", 4).alias("total"), "latest")


@query("WITH r AS (SELECT provider, count(*) AS fetched, count(*) FILTER (WHERE rank = 'species') AS created, count(*) FILTER (WHERE rank = 'genus') AS matched, count(*) FILTER (WHERE authorship IS NULL) AS rejected FROM provider_taxa GROUP BY 1) SELECT provider, fetched, created, matched, 0 AS revised, 0 AS conflicted, rejected, round((created + matched) / fetched, 6) AS acceptance, round(rejected / fetched, 6) AS error_rate FROM r")
def agg_runs(t: _T) -> DataFrame:
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    df = t("provider_taxa").select("provider", F.lit(1).alias("fetched"), one(F.col("rank") == "species").alias("created"), one(F.col("rank") == "genus").alias("matched"), F.lit(0).alias("revised"), F.lit(0).alias("conflicted"), one(F.col("authorship").isNull()).alias("rejected"))
    return summaries.run_summary(df, "provider")


@query("SELECT s AS value, count(*) AS count FROM (SELECT DISTINCT provider, provider_id, retrieved_at, unnest(synonyms) AS s FROM (SELECT DISTINCT provider, provider_id, retrieved_at, synonyms FROM provider_taxa)) GROUP BY 1")
def agg_breakdown(t: _T) -> DataFrame:
    return summaries.breakdown(t("provider_taxa").select("provider", "provider_id", "retrieved_at", "synonyms").distinct(), F.col("synonyms"))


@query("SELECT least(0.0, min(c_acctbal)) AS low, greatest(0.0, max(c_acctbal)) AS high FROM customer")
def agg_bounds(t: _T) -> DataFrame:
    return summaries.chart_bounds(t("customer"), "c_acctbal")


@query("SELECT 'k' AS field, count(*) AS records FROM events")
def prj_fields(t: _T) -> DataFrame:
    return summaries.discover_fields(t("events"), "props")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '17') OR contains(lower(c_mktsegment), '17') OR contains(CAST(c_nationkey AS VARCHAR), '17')")
def flt_grid(t: _T) -> DataFrame:
    return summaries.grid_filter(t("customer"), " 17 ", ["c_name", "c_mktsegment", "c_nationkey"]).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#2') AND p_size > 10 AND p_size <= 40 AND lower(p_name) <> 'small ring' AND contains(lower(p_type), 'e')")
def flt_index(t: _T) -> DataFrame:
    return summaries.index_filter(t("part"), {"p_brand": ["Brand#1", "BRAND#2"], "p_size": {"$gt": 10, "$lte": 40, "$what": 1}, "p_name": {"$ne": "Small Ring"}, "p_type": {"$contains": "E"}}).select("p_partkey")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' ORDER BY event_id DESC LIMIT 100")
def str_arrivals(t: _T) -> DataFrame:
    return summaries.arrivals(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_id", "2024-01-20 00:00:00").select("event_id")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10' AND event_type = 'click' AND user_id = 7")
def flt_map(t: _T) -> DataFrame:
    e = t("events").select("event_id", "ts", F.col("event_type").alias("species"), F.col("user_id").cast("string").alias("provider"))
    return summaries.map_stack(e, F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp"), "Click", "7").select("event_id")


@query(f"SELECT o_orderkey, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lat END AS lat, CASE WHEN lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 THEN lng END AS lng FROM ({_POINTS})")
def geo_aliases(t: _T) -> DataFrame:
    p = _raw_points(t)
    plain, named, json = F.struct("lat", "lng"), F.struct(F.col("lat").alias("decimalLatitude"), F.col("lng").alias("decimalLongitude")), F.struct(F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(plain)).when(F.col("o_orderkey") % 3 == 1, F.to_json(named)).otherwise(F.to_json(json))
    return p.select("o_orderkey", text.alias("j")).select("o_orderkey", *summaries.point_of("j"))


@query("SELECT p_brand AS label, sum(p_size)::BIGINT AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def ord_chart(t: _T) -> DataFrame:
    s = t("part").groupBy(F.col("p_brand").alias("label")).agg(F.sum("p_size").alias("value"))
    return summaries.chart_order(s, "label", "value", "desc").limit(10)


# --- resolution -----------------------------------------------------------------------------------------------------
_NEW = "SELECT * FROM provider_taxa QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY retrieved_at DESC NULLS LAST) = 1"
_HAVE = "SELECT * FROM taxa QUALIFY row_number() OVER (PARTITION BY speciedex_id ORDER BY loaded_at DESC NULLS LAST) = 1"


def _same(f: str) -> str:
    key = r"lower(trim(regexp_replace(coalesce({}.{}, ''), '\s+', ' ', 'g')))"
    a, b = key.format("a", f), key.format("b", f)
    return f"({a} <> '' AND {a} = {b})"


_BASIC = " + ".join(f"CASE WHEN {_same(f)} THEN {p} ELSE 0 END" for f, p in resolve.FIELD_POINTS.items() if f != "scientific_name")
_LINE = " + ".join(f"CASE WHEN {_same(f)} THEN {resolve.LINEAGE_POINTS} ELSE 0 END" for f in ("phylum", "class_name", "order_name", "family", "genus"))
_K = r"lower(trim(regexp_replace(coalesce({}.canonical_name, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(coalesce({}.rank, ''))) || '|' || lower(trim(coalesce({}.kingdom, '')))"


@query(f"WITH a AS ({_NEW}), b AS ({_HAVE}) SELECT a.provider, a.provider_id, b.speciedex_id, CAST({_BASIC} + least({resolve.LINEAGE_MOST}, {_LINE}) AS INTEGER) AS score FROM a JOIN b ON {_K.format('a', 'a', 'a')} = {_K.format('b', 'b', 'b')}")
def res_basic(t: _T) -> DataFrame:
    return resolve.basic_candidates(t("provider_taxa"), t("taxa"))


@query(f"WITH a AS (SELECT DISTINCT provider, provider_id FROM provider_taxa) SELECT provider, provider_id, 'conflicted' AS outcome FROM a WHERE length(provider_id) % 3 = 0 UNION ALL SELECT provider, provider_id, 'created' FROM a WHERE length(provider_id) % 3 = 1 UNION ALL SELECT provider, provider_id, 'matched' FROM a WHERE length(provider_id) % 3 = 2")
def res_apply(t: _T) -> DataFrame:
    n = F.length("provider_id") % 3
    actions = t("provider_taxa").select("provider", "provider_id").distinct().select("provider", "provider_id", F.when(n == 0, "conflict").when(n == 1, "create").otherwise("match").alias("action"), F.when(n == 2, "x").alias("speciedex_id"))
    return resolve.apply_result(actions, t("assertions"), t("provider_taxa")).select("provider", "provider_id", "outcome")


@query("SELECT value AS id, count(*) AS n FROM (SELECT sha256('[\"' || least(s_name, n_name) || '\",\"' || greatest(s_name, n_name) || '\"]') AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def res_pair_ids(t: _T) -> DataFrame:
    j = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.select(resolve.pair_id(F.col("s_name"), F.col("n_name")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rows, rows AS again FROM (SELECT count(*) AS rows FROM nation)")
def agg_set_hash(t: _T) -> DataFrame:
    """A record set has one digest, however it is ordered and cut."""
    a = sets.set_hash(t("nation"), ["n_nationkey", "n_name"])
    b = sets.set_hash(t("nation").repartition(7).orderBy(F.desc("n_name")), ["n_name", "n_nationkey"]).withColumnsRenamed({"rows": "again", "digest": "d"})
    return a.join(b, F.col("digest") == F.col("d")).select("rows", "again")


@query("SELECT c_nationkey AS key, arg_max(c_name, c_custkey) AS name FROM customer GROUP BY 1")
def ord_merge(t: _T) -> DataFrame:
    rows = t("customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), "c_custkey")
    old, new = rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 2 = 1")
    last = sets.merge_by_key(old, new, "key", "c_custkey").unionByName(old)
    return last.groupBy("key").agg(F.max_by("name", "c_custkey").alias("name"))


# --- keyed reads, rebuilds, the updatable index and whole records -----------------------------------------------------
@query("SELECT provider, provider_id, assertion_hash FROM assertions WHERE speciedex_id = (SELECT max(speciedex_id) FROM taxa) QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, assertion_hash DESC) = 1")
def src_keyed(t: _T) -> DataFrame:
    top = t("taxa").agg(F.max("speciedex_id")).first()[0]
    return keyed.of_taxon(t("assertions"), top).select("provider", "provider_id", "assertion_hash")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def src_read(t: _T) -> DataFrame:
    return keyed.read(t("orders"), o_orderstatus="P").select("o_orderkey", "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def snk_rebuild(t: _T) -> DataFrame:
    """A table from its records, of which older versions, damaged ones and ones without a key lie beside."""
    new = t("customer").select(F.to_json(F.struct("c_custkey", F.struct("c_name").alias("n"), F.lit("2025").alias("at"))).alias("j"))
    old = t("customer").select(F.to_json(F.struct("c_custkey", F.struct(F.lit("old").alias("c_name")).alias("n"), F.lit("2024").alias("at"))).alias("j"))
    rows = new.unionByName(old).unionByName(t("nation").select(F.to_json(F.struct("n_name")).alias("j"))).unionByName(t("region").select(F.concat(F.lit("{"), "r_name").alias("j")))
    return keyed.rebuild(rows, "j", {"id": "c_custkey", "name": "n.c_name", "updated_at": "at"}).select("id", "name")


_TOKENS = "SELECT p_partkey, unnest(list_filter(regexp_split_to_array(lower(n), '[^a-z0-9._:-]+'), lambda x: x <> '')) AS token FROM ({})"


@query("WITH d AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand ELSE p_name END AS n FROM part WHERE p_size > 5), w AS (" + _TOKENS.format("d") + ") SELECT p_partkey, token, count(*) AS n FROM w GROUP BY 1, 2")
def srh_crud(t: _T) -> DataFrame:
    """An index of names after some documents changed and some were removed."""
    from arborlake.plans.searchlang import postings

    docs = t("part").select("p_partkey", F.col("p_name").alias("n"), "p_size", "p_brand")
    index = postings(docs, "p_partkey", ["n"])
    index = keyed.index_add(index, docs.where("p_size > 40").select("p_partkey", F.col("p_brand").alias("n")), "p_partkey", ["n"])
    return keyed.index_remove(index, docs.where("p_size <= 5"), "p_partkey").select("p_partkey", "token", "n")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'small ring' AND p_size > 10")
def srh_pruned(t: _T) -> DataFrame:
    from arborlake.plans.searchlang import postings

    df = t("part")
    return keyed.pruned(df, postings(df, "p_partkey", ["p_name"]), "p_partkey", ["small", "ring"], (F.lower("p_name") == "small ring") & (F.col("p_size") > 10)).select("p_partkey")


_SPACE = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT provider_id, {_SPACE.format('scientific_name')} AS scientific_name, {_SPACE.format('family')} AS family, lower({_SPACE.format('rank')}) AS rank, {_SPACE.format('authorship')} AS authorship FROM provider_taxa WHERE lower(trim(rank)) IN ('species', 'genus', 'subspecies')")
def scl_records_basic(t: _T) -> DataFrame:
    rows = keyed.normalize(t("provider_taxa"), basic=True)
    return rows.where(F.col("rank").isin("species", "genus", "subspecies")).select("provider_id", "scientific_name", "family", "rank", "authorship").distinct()


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Aus bus' WHEN 1 THEN 'Aus × bus' WHEN 2 THEN 'Aus' ELSE 'Aus bus cus' END AS canonical_name, CASE p_partkey % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'species' WHEN 2 THEN 'genus' ELSE 'subspecies' END AS rank, CASE p_partkey % 4 WHEN 0 THEN 'Smith, 1900' WHEN 1 THEN 'A & B' WHEN 2 THEN '' ELSE 'C' END AS authorship, 'valid' AS status FROM part")
def scl_records(t: _T) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 4 + 1).cast("int"))
    df = t("part").select("p_partkey", pick("Aus  bus Smith, 1900", "Aus x bus", "Aus", "Aus bus cus C").alias("scientific_name"), pick("", "Aus ×bus", None, "Aus bus cus").alias("canonical_name"), pick("sp.", "Species", "", "ssp").alias("rank"), pick("Smith ,1900", "A&B", None, " C ").alias("authorship"), F.lit(" Valid  name").alias("status"))
    return keyed.normalize(df).select("p_partkey", "canonical_name", "rank", "authorship", "status")


@query("SELECT 'n' || n_nationkey AS node, row_number() OVER (ORDER BY 'r' || n_regionkey, 'n' || n_nationkey) AS place FROM nation WHERE n_nationkey % 2 = 0")
def geo_walk(t: _T) -> DataFrame:
    """Leaves of a pre-order walk down to the nodes that match."""
    from pyspark.sql import Window

    links = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("up")).unionByName(t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("up")))
    r = hierarchy.resolve(links, with_paths=True)
    rows = keyed.walk(r, "path", F.col("node").startswith("n") & (F.substring("node", 2, 9).cast("int") % 2 == 0)).where(F.col("node").startswith("n"))
    return rows.select("node", F.row_number().over(Window.orderBy("path")).cast("bigint").alias("place"))


@query("WITH a AS (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_size < 5), b AS (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_size > 10) SELECT (SELECT count(*) FROM a) AS \"left\", (SELECT count(*) FROM b) AS \"right\", count(*) AS both, (SELECT count(*) FROM a) - count(*) AS only_left, (SELECT count(*) FROM b) - count(*) AS only_right, round(count(*) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b) - count(*)), 6) AS jaccard FROM a JOIN b USING (k)")
def ext_accessors(t: _T) -> DataFrame:
    p = t("part")
    return keyed.overlap_by(p.where("p_size < 5"), p.where("p_size > 10"), F.lower("p_type"), F.lower("p_type"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY 1, 2")
def win_keys(t: _T) -> DataFrame:
    """Day and month keys, in UTC."""
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CASE event_type WHEN 'error' THEN 8.0 ELSE 0.0 END::DOUBLE AS wait FROM events GROUP BY 1")
def win_backoff(t: _T) -> DataFrame:
    return t("events").select("event_type").distinct().select("event_type", timeline.backoff(F.when(F.col("event_type") == "error", 4).otherwise(0), 1, 60).cast("double").alias("wait"))


@query("SELECT c_custkey, c_acctbal AS score FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def win_schedule(t: _T) -> DataFrame:
    low = t("customer").agg(F.min("c_mktsegment")).first()[0]
    return timeline.schedule(t("customer"), F.col("c_acctbal"), F.col("c_mktsegment") == low, 20, ["c_custkey"]).select("c_custkey", "score")


@query("SELECT event_id, make_timestamp(event_id * 1000000) AS at FROM events")
def win_event_time(t: _T) -> DataFrame:
    x = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("double")).otherwise(F.col("event_id").cast("double"))
    return t("events").select("event_id", timeline.event_time(x).cast("timestamp_ntz").alias("at"))


_IDENT = r"lower(trim(regexp_replace(coalesce({0}.canonical_name, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce({0}.rank, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce({0}.kingdom, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce({0}.authorship, ''), '\s+', ' ', 'g')))"
_ALL = " + ".join(f"CASE WHEN {_same(f)} THEN {p} ELSE 0 END" for f, p in resolve.FIELD_POINTS.items())
ORACLE["res_reconcile"] = f"""WITH a AS ({_NEW}), b AS ({_HAVE}), s AS (SELECT provider, provider_id, min(speciedex_id) AS s_id FROM source_ids GROUP BY 1, 2),
i AS (SELECT {_IDENT.format('b')} AS ident, count(*) AS i_n, min(speciedex_id) AS i_id FROM b GROUP BY 1),
p AS (SELECT a.provider, a.provider_id, b.speciedex_id AS c_id, {_ALL} + least({resolve.LINEAGE_MOST}, {_LINE}) + CASE WHEN trim(coalesce(a.accepted_provider_id, '')) <> '' THEN {resolve.ACCEPTED_ID_POINTS} ELSE 0 END AS raw FROM a JOIN b ON {_K.format('a', 'a', 'a')} = {_K.format('b', 'b', 'b')}),
q AS (SELECT *, CASE WHEN raw < {resolve.LEAST} THEN least(raw * 0.85, {resolve.CONFLICT} - 0.01) ELSE raw * 0.85 END::DOUBLE AS score FROM p),
g AS (SELECT provider, provider_id, score, count(*) AS ties, min(c_id) AS c_id FROM q GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY score DESC) = 1),
j AS (SELECT a.provider, a.provider_id, s_id, i_n, i_id, score, ties, c_id FROM a LEFT JOIN s ON s.provider = a.provider AND s.provider_id = a.provider_id LEFT JOIN i ON i.ident = {_IDENT.format('a')} LEFT JOIN g ON g.provider = a.provider AND g.provider_id = a.provider_id)
SELECT provider, provider_id, CASE WHEN s_id IS NOT NULL THEN 'match' WHEN i_n = 1 THEN 'match' WHEN i_n > 1 THEN 'conflict' WHEN score >= {resolve.MATCH} AND ties = 1 THEN 'match' WHEN score >= {resolve.CONFLICT} THEN 'conflict' ELSE 'create' END AS action,
CASE WHEN s_id IS NOT NULL THEN s_id WHEN i_n = 1 THEN i_id WHEN score >= {resolve.MATCH} AND ties = 1 AND i_n IS NULL THEN c_id END AS speciedex_id, round(score, 6) AS score,
CASE WHEN s_id IS NOT NULL THEN 'source_id' WHEN i_n = 1 THEN 'identity' WHEN i_n > 1 THEN 'ambiguous_identity' WHEN score >= {resolve.CONFLICT} THEN 'scored' ELSE 'new' END AS reason FROM j"""


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_KEY = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"
_BLANK = "trim(coalesce({}, '')) = ''"
_RANKED = [*X.RANKS, *X.RANK_ALIASES]
_CANON = f"CASE WHEN {_KEY.format('rank')} IN {_in(X.RANKS)} THEN {_KEY.format('rank')} " + " ".join(f"WHEN {_KEY.format('rank')} = '{a}' THEN '{r}'" for a, r in X.RANK_ALIASES.items()) + " ELSE 'unranked' END"
_STATUS = f"CASE " + " ".join(f"WHEN {_KEY.format('status')} = '{a}' THEN '{r}'" for a, r in X.STATUS_ALIASES.items()) + f" ELSE {_KEY.format('status')} END"
_RULES = [(f"{f}_missing", "error", f, _BLANK.format(f)) for f in ("provider", "provider_id", "scientific_name", "canonical_name")]
_RULES += [(f"{f}_placeholder", "error", f, f"lower(trim({f})) IN {_in(resolve.PLACEHOLDERS)}") for f in ("scientific_name", "canonical_name")]
_RULES += [
    ("rank_unknown", "warning", "rank", f"{_KEY.format('rank')} NOT IN {_in(_RANKED)}"),
    ("status_unknown", "warning", "status", f"{_STATUS} NOT IN {_in(archive.ACCEPTED + archive.SYNONYM + archive.UNCERTAIN)}"),
    ("accepted_id_self_reference", "error", "accepted_provider_id", f"NOT {_BLANK.format('accepted_provider_id')} AND accepted_provider_id = provider_id"),
    ("synonym_target_missing", "warning", "accepted_provider_id", f"{_STATUS} IN {_in(archive.SYNONYM)} AND {_BLANK.format('accepted_provider_id')}"),
    ("accepted_taxon_has_target", "warning", "accepted_provider_id", f"{_STATUS} IN {_in(archive.ACCEPTED)} AND NOT {_BLANK.format('accepted_provider_id')} AND accepted_provider_id <> provider_id"),
    ("canonical_name_mismatch", "warning", "canonical_name", f"NOT {_BLANK.format('canonical_name')} AND NOT starts_with({_KEY.format('scientific_name')}, {_KEY.format('canonical_name')})"),
    ("lineage_empty", "warning", "kingdom", " AND ".join(_BLANK.format(c) for c in ("kingdom", "phylum", "class_name", "order_name", "family", "genus"))),
    ("genus_missing", "warning", "genus", f"list_position({X.RANKS!r}, {_CANON}) > {X.RANKS.index('genus') + 1} AND {_BLANK.format('genus')}"),
    ("source_url_non_http", "warning", "source_url", f"NOT {_BLANK.format('source_url')} AND NOT regexp_matches(lower(source_url), '^https?://')"),
]
ORACLE["res_taxa"] = "SELECT provider, provider_id, i.code AS code, i.severity AS severity, i.field AS field FROM (SELECT provider, provider_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {{'code': '{n}', 'severity': '{s}', 'field': '{f}'}} END" for n, s, f, c in _RULES) + "], lambda x: x IS NOT NULL)) AS i FROM provider_taxa)"
