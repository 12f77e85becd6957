"""Queries of the engine's own operators over the data tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.functions import taxonomy as X
from arborlake.operators import archive, geo, graph, resolve, sets, stats, timeline
from arborlake.plans import filterlang, indexes, lists, searchlang
from arborlake.session import shared_folder, table
from arborlake.streaming import streams

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


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison."""
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if k == "double" else F.col(f"`{n}`") for n, k in df.dtypes])


# --- predicates -------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50")
def flt_page(t: _T) -> DataFrame:
    return filterlang.filter_records(t("orders"), {"o_orderstatus": {"$eq": "f"}, "o_totalprice": {"$gte": 100000}}, sort="o_totalprice", order="desc", limit=50, page=2, select=["o_orderkey", "o_totalprice", "o_orderdate"], tie=["o_orderkey"]).rows


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY 1")
def flt_facet(t: _T) -> DataFrame:
    return filterlang.filter_records(t("orders"), {"o_orderstatus": "F", "o_totalprice": {"$gte": 100000}}, facets=["o_orderpriority"]).facets["o_orderpriority"]


def _parts(spec):
    return lambda t: t("part").where(filterlang.compile_filter(t("part"), spec)).select("p_partkey")


for _name, _spec, _sql in [
    ("flt_starts_with", {"p_name": {"$startsWith": "S"}}, "lower(p_name) LIKE 's%'"),
    ("flt_ends_with", {"p_name": {"$endsWith": "RING"}}, "lower(p_name) LIKE '%ring'"),
    ("flt_contains", {"p_name": "ring"}, "lower(p_name) LIKE '%ring%'"),
    ("flt_wildcard", {"p_name": {"$wildcard": "s*g"}}, "lower(p_name) LIKE 's%g'"),
    ("flt_regex", {"p_name": {"$regex": "/^[a-m].*t$/i"}}, "regexp_matches(p_name, '(?i)^[a-m].*t$')"),
    ("flt_in", {"p_brand": ["Brand#1", "brand#2"], "p_size": {"$nin": [1, 2, 3]}}, "lower(p_brand) IN ('brand#1', 'brand#2') AND p_size NOT IN (1, 2, 3)"),
    ("flt_between", {"p_size": {"$between": [10, 20]}}, "p_size BETWEEN 10 AND 20"),
    ("flt_min_max", {"p_size": {"min": 10, "max": 12}}, "p_size BETWEEN 10 AND 12"),
    ("flt_logic", {"$or": [{"p_size": {"$lt": 5}}, {"$and": [{"p_size": {"$gt": 45}}, {"$not": {"p_name": "ring"}}]}]}, "p_size < 5 OR (p_size > 45 AND lower(p_name) NOT LIKE '%ring%')"),
    ("flt_not_equal", {"p_size": {"$ne": 7}, "p_brand": {"$ne": "Brand#3"}}, "p_size <> 7 AND lower(p_brand) <> 'brand#3'"),
    ("flt_size", {"p_brand": {"$size": 8}}, "length(p_brand) = 8"),
    ("flt_type_exists", {"p_size": {"$type": "number"}, "p_name": {"$exists": True}}, "p_name IS NOT NULL AND p_size IS NOT NULL"),
    ("flt_text_order", {"p_name": {"$gte": "m"}}, "lower(p_name) >= 'm'"),
]:
    QUERIES[_name] = (lambda spec: lambda spark, d: _parts(spec)(lambda n: table(spark, d, n)))(_spec)
    ORACLE[_name] = f"SELECT p_partkey FROM part WHERE {_sql}"


@query("SELECT taxon_key FROM iconforge_taxa WHERE NOT coalesce(lower(trim(status)) = 'accepted', FALSE) AND (parent_key IS NULL OR lower(trim(rank)) = 'genus')")
def flt_nulls(t: _T) -> DataFrame:
    df = t("iconforge_taxa")
    return df.where(filterlang.compile_filter(df, [{"$not": {"status": {"$eq": "accepted"}}}, {"$or": [{"parent_key": {"$eq": None}}, {"rank": {"$eq": "genus"}}]}])).select("taxon_key")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-06-01 00:00:00'")
def flt_dates(t: _T) -> DataFrame:
    return t("orders").where(filterlang.compile_filter(t("orders"), {"o_orderdate": {"$gt": "1996-03-01T00:00:00", "$lt": "1996-06-01T00:00:00"}})).select("o_orderkey")


@query("SELECT s.speciedex_id FROM (SELECT DISTINCT speciedex_id, lower(to_json({'k': kingdom, 'f': family})) AS j FROM taxa) s WHERE j LIKE '%plantae%'")
def flt_whole_record(t: _T) -> DataFrame:
    df = t("taxa").select("speciedex_id", F.lower(F.to_json(F.struct(F.col("kingdom").alias("k"), F.col("family").alias("f")), {"ignoreNullFields": "false"})).alias("j")).distinct()
    return df.where(F.col("j").contains("plantae")).select("speciedex_id")


# --- search -----------------------------------------------------------------------------------------------------
_SCORE = "(CASE WHEN lower(p_name) = 'ring' THEN 10 WHEN lower(p_name) LIKE 'ring%' THEN 6 WHEN lower(p_name) LIKE '%ring%' THEN 3 ELSE 0 END)"


@query(f"SELECT p_partkey, CAST((CASE WHEN lower(p_brand) = 'brand#2' THEN 10 WHEN lower(p_brand) LIKE 'brand#2%' THEN 6 ELSE 0 END) + {_SCORE} AS BIGINT) AS score FROM part WHERE lower(p_brand) = 'brand#2' OR (lower(p_name) LIKE '%ring%' AND NOT p_size > 20) ORDER BY score DESC, p_partkey LIMIT 100")
def srh_boolean(t: _T) -> DataFrame:
    return searchlang.search(t("part"), "p_brand=Brand#2 OR (p_name:ring AND NOT p_size>20)", fuzzy=False, limit=100, tie=["p_partkey"])[0].select("p_partkey", "score")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%rinf%' OR len(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+'), lambda w: levenshtein(w, 'rinf') <= 1)) > 0")
def srh_fuzzy(t: _T) -> DataFrame:
    comp = searchlang.Compiler(t("part"), ["p_name"])
    return t("part").where(comp.match(searchlang.parse("rinf"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%plate%') AND p_size >= 30 AND lower(p_name) NOT LIKE '%small%'")
def srh_linear(t: _T) -> DataFrame:
    comp = searchlang.Compiler(t("part"), ["p_name"], fuzzy=False)
    return t("part").where(comp.match(searchlang.parse("ring OR plate p_size>=30 -small", "linear"))).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'limestone scree') AND lang = 'en'")
def srh_quoted(t: _T) -> DataFrame:
    comp = searchlang.Compiler(t("documents"), ["text"], fuzzy=False)
    return t("documents").where(comp.match(searchlang.parse('"limestone scree" lang="en"'))).select("doc_id")


@query("SELECT speciedex_id, count(*) AS rows FROM taxa WHERE trim(coalesce(authorship, '')) <> '' AND NOT coalesce(contains(lower(kingdom), 'animalia'), FALSE) AND coalesce(regexp_matches(lower(genus), '(?is)^gl.*us$'), FALSE) GROUP BY 1")
def srh_has(t: _T) -> DataFrame:
    comp = searchlang.Compiler(t("taxa"), ["scientific_name"], fuzzy=False)
    return t("taxa").where(comp.match(searchlang.parse("has:authorship -kingdom:animalia genus:gl*us"))).groupBy("speciedex_id").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%ring%' THEN CASE WHEN lower(trim(p_name)) = 'ring' THEN 60.0 ELSE 20.0 END ELSE 0.0 END::DOUBLE AS score FROM part")
def srh_terminal_score(t: _T) -> DataFrame:
    comp = searchlang.Compiler(t("part"), ["p_name"], fuzzy=False)
    return t("part").select("p_partkey", searchlang.terminal_score(comp, searchlang.parse("ring", "linear"), {"p_name": 20}).alias("score"))


@query("SELECT token, p_partkey, count(*) AS n FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+')) AS token FROM part) WHERE token <> '' GROUP BY 1, 2")
def srh_postings(t: _T) -> DataFrame:
    return searchlang.postings(t("part"), "p_partkey", ["p_name"])


@query("SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+'), 'small') AND list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+'), 'ring')")
def srh_lookup(t: _T) -> DataFrame:
    return searchlang.lookup(searchlang.postings(t("part"), "p_partkey", ["p_name"]), "p_partkey", ["small", "ring"])


# --- counts and joins of the archive ----------------------------------------------------------------------------
@query("SELECT rank, count(*) AS count FROM taxa WHERE lower(trim(status)) IN ('accepted', 'valid', 'provisionally accepted', 'unknown', 'reference') AND trim(coalesce(rank, '')) <> '' GROUP BY 1")
def agg_rank_counts(t: _T) -> DataFrame:
    return archive.counts(t("taxa"), "rank", F.lower(F.trim("status")).isin(archive.ACTIVE))


@query("SELECT coalesce(nullif(trim(kingdom), ''), 'unknown') AS kingdom, count(*) AS count FROM taxa GROUP BY 1")
def agg_kingdoms(t: _T) -> DataFrame:
    return archive.counts(t("taxa"), "kingdom", blank="unknown")


@query("SELECT provider, CAST(sum(a) AS BIGINT) AS source_ids, CAST(sum(b) AS BIGINT) AS assertions, CAST(sum(c) AS BIGINT) AS synonyms FROM (SELECT provider, 1 AS a, 0 AS b, 0 AS c FROM source_ids UNION ALL SELECT provider, 0, 1, 0 FROM assertions UNION ALL SELECT provider, 0, 0, 1 FROM synonyms) GROUP BY 1")
def agg_providers(t: _T) -> DataFrame:
    return archive.provider_statistics(t("source_ids"), t("assertions"), t("synonyms"))


@query("SELECT count(*) AS count FROM (SELECT canonical_name AS n FROM taxa WHERE lower(rank) = 'genus' AND trim(canonical_name) <> '' UNION SELECT genus FROM taxa WHERE trim(genus) <> '')")
def agg_lineage(t: _T) -> DataFrame:
    return archive.lineage_count(t("taxa"), "genus", "genus")


@query("WITH t1 AS (SELECT speciedex_id, max(lower(trim(status))) AS s FROM taxa GROUP BY 1) SELECT provider, count(*) FILTER (WHERE s IN ('accepted', 'valid', 'provisionally accepted')) AS accepted, count(*) FILTER (WHERE s IN ('synonym', 'unaccepted', 'invalid', 'misapplied', 'superseded', 'deprecated')) AS synonym, count(*) FILTER (WHERE s IS NULL OR s NOT IN ('accepted', 'valid', 'provisionally accepted', 'synonym', 'unaccepted', 'invalid', 'misapplied', 'superseded', 'deprecated')) AS unknown FROM assertions JOIN t1 USING (speciedex_id) GROUP BY 1")
def jon_status_fold(t: _T) -> DataFrame:
    one = t("taxa").groupBy("speciedex_id").agg(F.max(F.lower(F.trim("status"))).alias("status"))
    return archive.status_fold(t("assertions"), one)


@query("SELECT provider, max(loaded_at) AS latest FROM assertions GROUP BY 1")
def agg_latest(t: _T) -> DataFrame:
    return t("assertions").groupBy("provider").agg(F.max("loaded_at").alias("latest"))


@query("SELECT synonym_key, count(DISTINCT speciedex_id) AS n FROM synonyms GROUP BY 1 HAVING count(DISTINCT speciedex_id) > 1")
def agg_ambiguous(t: _T) -> DataFrame:
    return archive.ambiguous(t("synonyms"), "synonym_key", "speciedex_id")


@query("SELECT count(*) AS rows, count(DISTINCT synonym_key) AS keys, count(DISTINCT speciedex_id) AS taxa, count(DISTINCT provider) AS providers FROM synonyms")
def agg_synonyms(t: _T) -> DataFrame:
    return t("synonyms").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("synonym_key").alias("keys"), F.count_distinct("speciedex_id").alias("taxa"), F.count_distinct("provider").alias("providers"))


@query("SELECT c_mktsegment, count(DISTINCT o_orderkey) AS orders, count(*) AS lines, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def jon_three_way(t: _T) -> DataFrame:
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count_distinct("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("lines"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def jon_anti(t: _T) -> DataFrame:
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jon_semi(t: _T) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT n_nationkey, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey")
def agg_merged(t: _T) -> DataFrame:
    s = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    j = s.join(c, "k", "full_outer").fillna(0)
    return t("nation").join(j, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("SELECT count(*) AS n FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region)")
def ord_union(t: _T) -> DataFrame:
    return t("nation").select(F.col("n_name").alias("x")).unionByName(t("region").select(F.col("r_name").alias("x"))).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def agg_having(t: _T) -> DataFrame:
    return archive.ambiguous(t("events"), "user_id", "event_type")


@query("SELECT l_partkey, l_suppkey, count(*) AS n, min(l_orderkey) AS first_member, max(l_orderkey) AS last_member FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_duplicates(t: _T) -> DataFrame:
    return sets.duplicates(t("lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("SELECT lower(synonym_key) AS synonym_key, count(DISTINCT speciedex_id) AS taxa FROM synonyms GROUP BY 1")
def jon_synonyms(t: _T) -> DataFrame:
    return t("synonyms").groupBy(F.lower("synonym_key").alias("synonym_key")).agg(F.count_distinct("speciedex_id").alias("taxa"))


@query("SELECT t.rank, count(*) AS n FROM synonyms s JOIN (SELECT speciedex_id, min(rank) AS rank FROM taxa GROUP BY 1) t USING (speciedex_id) GROUP BY 1")
def jon_synonym_ranks(t: _T) -> DataFrame:
    return t("synonyms").join(t("taxa").groupBy("speciedex_id").agg(F.min("rank").alias("rank")), "speciedex_id").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT provider, provider_id, speciedex_id, loaded_at FROM source_ids WHERE provider IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, speciedex_id DESC) = 1")
def snk_upsert(t: _T) -> DataFrame:
    rows = t("source_ids").where("provider is not null")
    return archive.upsert(rows.where("loaded_at < '2025-01-01'"), rows.where("loaded_at >= '2025-01-01' or loaded_at is null"), ["provider", "provider_id"], ["loaded_at", "speciedex_id"]).select("provider", "provider_id", "speciedex_id", "loaded_at")


@query("""WITH a AS (SELECT provider, provider_id, assertion_hash, updated_at FROM assertions WHERE loaded_at < TIMESTAMP '2025-01-01' QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, assertion_hash DESC) = 1),
b AS (SELECT provider, provider_id, assertion_hash FROM assertions WHERE loaded_at >= TIMESTAMP '2025-01-01' QUALIFY row_number() OVER (PARTITION BY provider, provider_id ORDER BY loaded_at DESC, assertion_hash DESC) = 1)
SELECT provider, provider_id, a.assertion_hash AS previous_assertion_hash, b.assertion_hash FROM a JOIN b USING (provider, provider_id) WHERE a.assertion_hash <> b.assertion_hash""")
def snk_revisions(t: _T) -> DataFrame:
    rows = t("assertions")
    old = timeline.latest(rows.where("loaded_at < '2025-01-01'"), ["provider", "provider_id"], ["loaded_at", "assertion_hash"])
    new = timeline.latest(rows.where("loaded_at >= '2025-01-01'"), ["provider", "provider_id"], ["loaded_at", "assertion_hash"])
    return archive.attach_assertions(old, new)[1].select("provider", "provider_id", "previous_assertion_hash", "assertion_hash")


@query("""WITH a AS (SELECT taxon_key, max(source_record_hash) AS h FROM iconforge_taxa WHERE indexed_at < TIMESTAMP '2025-03-01' GROUP BY 1), b AS (SELECT taxon_key, max(source_record_hash) AS h FROM iconforge_taxa GROUP BY 1)
SELECT event, count(*) AS n FROM (SELECT CASE WHEN a.h IS NULL THEN 'inserted' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS event FROM b LEFT JOIN a USING (taxon_key)) GROUP BY 1""")
def snk_import(t: _T) -> DataFrame:
    rows = t("iconforge_taxa")
    one = lambda df: df.groupBy("taxon_key").agg(F.max("source_record_hash").alias("source_record_hash"))
    index = one(rows.where("indexed_at < '2025-03-01'")).withColumn("state", F.lit("done"))
    return archive.import_records(index, one(rows), "taxon_key", "source_record_hash").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


# --- statistics -------------------------------------------------------------------------------------------------
_NUM = "count(x) AS num_count, round(sum(x), 2) AS num_sum, min(x) AS num_min, max(x) AS num_max, round(avg(x), 4) AS num_mean, round(quantile_cont(x, 0.5), 4) AS num_median, round(coalesce(var_samp(x), 0), 3) AS num_variance, round(sqrt(coalesce(var_samp(x), 0)), 4) AS num_stddev, round(quantile_cont(x, 0), 4) AS num_p0, round(quantile_cont(x, 0.25), 4) AS num_p25, round(quantile_cont(x, 0.5), 4) AS num_p50, round(quantile_cont(x, 0.75), 4) AS num_p75, round(quantile_cont(x, 1), 4) AS num_p100"
_FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT field, count(*) AS records, count(*) FILTER (WHERE x IS NULL) AS nulls, round(count(*) FILTER (WHERE x IS NULL) / count(*), 6) AS null_rate, count(DISTINCT x) AS distinct_values, " + _NUM + " FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f}::DOUBLE AS x FROM lineitem" for f in _FIELDS) + ") GROUP BY 1")
def agg_profile(t: _T) -> DataFrame:
    df = stats.profile(t("lineitem"), _FIELDS)
    digits = {"num_sum": 2, "num_variance": 3}
    return df.select(*[F.round(c, digits.get(c, 4)).alias(c) if c.startswith("num_") and c not in ("num_count", "num_min", "num_max") else F.col(c) for c in df.columns])


@query("SELECT l_returnflag AS \"group\", count(*) AS records, count(l_quantity) AS l_quantity_count, round(avg(l_quantity), 6) AS l_quantity_mean, round(quantile_cont(l_quantity, 0.5), 6) AS l_quantity_median FROM lineitem GROUP BY 1")
def agg_grouped(t: _T) -> DataFrame:
    return _r(stats.grouped(t("lineitem"), "l_returnflag", ["l_quantity"]).select("group", "records", "l_quantity_count", "l_quantity_mean", "l_quantity_median"))


@query("""WITH s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 AS step FROM lineitem), b AS (SELECT CAST(least(9, floor((l_extendedprice - lo) / step)) AS INTEGER) AS bin FROM lineitem, s)
SELECT bin, round(lo + bin * step, 4) AS low, count(*) AS count, CAST(sum(count(*)) OVER (ORDER BY bin) AS BIGINT) AS cumulative FROM b, s GROUP BY bin, lo, step""")
def agg_histogram(t: _T) -> DataFrame:
    return _r(stats.histogram(t("lineitem"), "l_extendedprice", 10).select("bin", "low", "count", "cumulative"), 4)


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def agg_correlation(t: _T) -> DataFrame:
    return _r(stats.correlations(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT count(*) AS count, sum(l_quantity) AS weight, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem")
def agg_density(t: _T) -> DataFrame:
    return _r(stats.density_summary(t("lineitem"), "l_extendedprice", "l_quantity").select("count", "weight", "mean", "q1", "median", "q3"), 4)


@query("""WITH s AS (SELECT count(*) AS n, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi, stddev_samp(p_size) AS sd, quantile_cont(p_size::DOUBLE, 0.75) - quantile_cont(p_size::DOUBLE, 0.25) AS iqr FROM part), h AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h FROM s), g AS (SELECT i AS point, lo + i * (hi - lo) / 15 AS x, h, n FROM h, (SELECT unnest(range(0, 16)) AS i))
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - p_size) / h, 2)) / 2.5066282746310002) / any_value(n * h), 6) AS density FROM g, part GROUP BY point, x""")
def agg_kernel(t: _T) -> DataFrame:
    return _r(stats.kernel_density(t("part"), "p_size", points=16))


@query("""WITH c AS (SELECT c_mktsegment AS r, o_orderpriority AS c, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT r AS row, c AS "column", v AS value, round((v - min(v) OVER (PARTITION BY r)) / (max(v) OVER (PARTITION BY r) - min(v) OVER (PARTITION BY r)), 6) AS scaled FROM c""")
def agg_matrix(t: _T) -> DataFrame:
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = stats.matrix(j, "c_mktsegment", "o_orderpriority", "o_totalprice", "sum", fill=0.0, scale="row")
    return m.select("row", "column", F.round("value", 2).alias("value"), F.round("scaled", 6).alias("scaled"))


@query(r"SELECT lower(w) AS key, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(text, '[\s,;|/\\]+')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 80 GROUP BY 1")
def agg_words(t: _T) -> DataFrame:
    return stats.word_counts(t("documents"), "text").select("key", "count")


@query("SELECT count(value) AS count, round(sum(value), 3) AS sum, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 100) AS le_100 FROM events")
def agg_buckets(t: _T) -> DataFrame:
    df = stats.cumulative_buckets(t("events"), "value", [10, 50, 100])
    return df.withColumn("sum", F.round("sum", 3)).withColumn("mean", F.round("mean", 6))


@query("SELECT 'total' AS section, 'records' AS name, count(*)::DOUBLE AS value FROM taxa UNION ALL SELECT 'flag', 'deleted', count(*) FILTER (WHERE lower(trim(status)) = 'deleted')::DOUBLE FROM taxa UNION ALL SELECT 'by_rank', rank, count(*)::DOUBLE FROM taxa WHERE rank <> '' GROUP BY rank UNION ALL SELECT 'metric', 'line_number_' || n, v FROM (SELECT unnest(['count', 'min', 'max', 'avg']) AS n, unnest([count(line_number)::DOUBLE, min(line_number)::DOUBLE, max(line_number)::DOUBLE, round(avg(line_number), 6)]) AS v FROM taxa)")
def agg_summary(t: _T) -> DataFrame:
    return stats.summarize(t("taxa"), {"deleted": F.lower(F.trim("status")) == "deleted"}, ["rank"], ["line_number"])


@query("SELECT 'lang' AS field, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'null' ELSE 'string' END AS type, count(*) AS count FROM documents GROUP BY 2 UNION ALL SELECT 'n_chars', CASE WHEN n_chars IS NULL THEN 'null' ELSE 'number' END, count(*) FROM documents GROUP BY 2")
def agg_types(t: _T) -> DataFrame:
    return stats.type_histogram(t("documents"), ["lang", "n_chars"])


@query("SELECT 'p_name' AS field, p_name AS value, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, p_name) AS INTEGER) AS rank FROM part GROUP BY 2 QUALIFY rank <= 10")
def agg_top_values(t: _T) -> DataFrame:
    return stats.top_values(t("part"), ["p_name"], 10)


# --- time -------------------------------------------------------------------------------------------------------
_KEYS = {"day": "strftime(s, '%Y-%m-%d')", "week": "isoyear(s)::VARCHAR || '-W' || lpad(week(s)::VARCHAR, 2, '0')", "month": "strftime(s, '%Y-%m')", "quarter": "year(s)::VARCHAR || '-Q' || quarter(s)::VARCHAR", "year": "strftime(s, '%Y')", "hour": "strftime(s, '%Y-%m-%dT%H:00')", "minute": "strftime(s, '%Y-%m-%dT%H:%M')"}
for _b, _k in _KEYS.items():
    QUERIES["win_timeline_" + _b] = (lambda b: lambda spark, d: timeline.timeline(table(spark, d, "events"), "ts", b, by="event_type", cumulative=True).select("group", "bucket", "count", "running"))(_b)
    ORACLE["win_timeline_" + _b] = f"SELECT event_type AS \"group\", {_k} AS bucket, n AS count, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY s) AS BIGINT) AS running FROM (SELECT event_type, date_trunc('{_b}', ts) AS s, count(*) AS n FROM events GROUP BY 1, 2)"


@query("""WITH c AS (SELECT event_type AS g, date_trunc('hour', ts) AS s, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT g, unnest(generate_series(min(s), max(s), INTERVAL 1 HOUR)) AS s FROM c GROUP BY 1) SELECT e.g AS "group", e.s AS start, coalesce(n, 0) AS count FROM e LEFT JOIN c ON c.g = e.g AND c.s = e.s""")
def win_fill(t: _T) -> DataFrame:
    return timeline.timeline(t("events"), "ts", "hour", by="event_type", fill=True).select("group", "start", "count")


@query("SELECT day, n, n - coalesce(lag(n) OVER (ORDER BY day), n) AS delta_n FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1)")
def win_deltas(t: _T) -> DataFrame:
    daily = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.deltas(daily, "day", ["n"])


@query("SELECT event_type, day, n, n - coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY day), 0) AS delta_n FROM (SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def win_provider_deltas(t: _T) -> DataFrame:
    daily = t("events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.deltas(daily, "day", ["n"], ["event_type"], "value")


@query("WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7) SELECT arg_min(n, day) AS first, arg_max(n, day) AS last, count(*) AS points, arg_max(n, day) - arg_min(n, day) AS delta FROM d")
def win_trend(t: _T) -> DataFrame:
    daily = t("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return timeline.trend(daily, "day", "n").select("first", "last", "points", "delta")


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win_latest(t: _T) -> DataFrame:
    return timeline.latest(t("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts) RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS trailing FROM events")
def win_trailing(t: _T) -> DataFrame:
    return timeline.trailing_counts(t("events"), "ts", 600, "event_type").select("event_id", "trailing")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def win_top(t: _T) -> DataFrame:
    return timeline.rank_records(t("part"), "p_retailprice", ["p_partkey"]).select("p_partkey", "p_retailprice")


@query("SELECT min(ts) AS first, max(ts) AS last, count(ts) AS valid, count(*) - count(ts) AS invalid, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms FROM events")
def win_range(t: _T) -> DataFrame:
    return timeline.time_range(t("events"), "ts")


@query("SELECT l_returnflag, day, n FROM (SELECT l_returnflag, date_trunc('month', l_shipdate) AS day, count(*) % 3 AS n FROM lineitem GROUP BY 1, 2) QUALIFY NOT coalesce(n = lead(n) OVER (PARTITION BY l_returnflag ORDER BY day), FALSE)")
def win_collapse(t: _T) -> DataFrame:
    m = t("lineitem").groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("day")).agg((F.count(F.lit(1)) % 3).alias("n"))
    return timeline.collapse_unchanged(m, "day", ["n"], ["l_returnflag"], keep=100_000)


@query("SELECT l_returnflag, l_linestatus, n::DOUBLE AS value, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) - n)::DOUBLE AS low, (sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_linestatus))::DOUBLE AS high FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def win_stack(t: _T) -> DataFrame:
    return timeline.stack(t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")), "l_returnflag", "l_linestatus", "n")


# --- sets and orders --------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT user_id::VARCHAR AS u FROM events WHERE event_type = 'view'), b AS (SELECT user_id::VARCHAR AS u FROM events WHERE event_type = 'purchase'), c AS (SELECT (SELECT count(*) FROM a WHERE u IN (SELECT u FROM b)) AS s, (SELECT count(*) FROM a) AS l, (SELECT count(*) FROM b) AS r)
SELECT s AS shared, l AS left_rows, r AS right_rows, round(s / (l + r - s), 6) AS jaccard, round(s / least(l, r), 6) AS overlap FROM c""")
def jon_overlap(t: _T) -> DataFrame:
    e = t("events").select("user_id", "event_type")
    return sets.overlap_measures(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")


@query("""WITH k AS (SELECT DISTINCT event_type AS s, user_id AS k FROM events), n AS (SELECT s, count(*) AS n FROM k GROUP BY 1), p AS (SELECT a.s AS l, b.s AS r, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2)
SELECT l AS "left", r AS "right", c AS shared, x.n AS left_size, y.n AS right_size, round(c / (x.n + y.n - c), 6) AS jaccard, round(2 * c / (x.n + y.n), 6) AS dice, round(greatest(c / x.n, c / y.n), 6) AS containment, c / (x.n + y.n - c) >= 0.99 AS duplicate, abs(c / x.n - c / y.n) >= 0.25 AS asymmetric FROM p JOIN n x ON x.s = l JOIN n y ON y.s = r""")
def jon_pairwise(t: _T) -> DataFrame:
    return sets.pairwise_overlap(t("events"), "event_type", "user_id")


@query("SELECT provider, count(DISTINCT speciedex_id) AS keys, round(count(DISTINCT speciedex_id) / (SELECT count(DISTINCT speciedex_id) FROM source_ids), 6) AS share FROM source_ids WHERE speciedex_id IS NOT NULL GROUP BY 1")
def agg_coverage(t: _T) -> DataFrame:
    return sets.coverage(t("source_ids"), "provider", "speciedex_id")


@query("SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def ord_union_by_key(t: _T) -> DataFrame:
    return sets.union_by_key([t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))], "name", "key")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20")
def ord_worker_sort(t: _T) -> DataFrame:
    return t("customer").orderBy(C.ordering(F.col("c_acctbal"), True), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT taxon_key, parent_key FROM iconforge_taxa WHERE rank = 'genus' ORDER BY parent_key ASC NULLS FIRST, taxon_key, provider_id LIMIT 30")
def ord_grid_sort(t: _T) -> DataFrame:
    return t("iconforge_taxa").where("rank = 'genus'").orderBy(C.ordering(F.col("parent_key"), False, "grid"), "taxon_key", "provider_id").limit(30).select("taxon_key", "parent_key")


@query("SELECT coalesce(a.p, b.p) AS path, a.v AS before, b.v AS after, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'changed' END AS change FROM (SELECT event_type AS p, count(*) AS v FROM events WHERE day(ts) = 1 GROUP BY 1) a FULL JOIN (SELECT event_type AS p, count(*) AS v FROM events WHERE day(ts) = 2 AND event_type <> 'click' GROUP BY 1) b ON a.p = b.p")
def ord_diff(t: _T) -> DataFrame:
    day = lambda n: t("events").where(F.dayofmonth("ts") == n).groupBy(F.col("event_type").alias("p")).agg(F.count(F.lit(1)).alias("v"))
    return sets.difference(day(1), day(2).where("p <> 'click'"), "p", "v")


@query("SELECT user_id FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 2")
def ord_tags(t: _T) -> DataFrame:
    return sets.tagged(t("events"), "user_id", "event_type", ["view", "purchase"], "all")


# --- scalars ----------------------------------------------------------------------------------------------------
@query(r"SELECT DISTINCT speciedex_id, lower(trim(regexp_replace(coalesce(canonical_name, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce(rank, ''), '\s+', ' ', 'g'))) || '|' || lower(trim(regexp_replace(coalesce(kingdom, ''), '\s+', ' ', 'g'))) AS key FROM taxa")
def scl_identity(t: _T) -> DataFrame:
    return t("taxa").select("speciedex_id", F.concat_ws("|", X.key(F.col("canonical_name")), X.key(F.col("rank")), X.key(F.col("kingdom"))).alias("key")).distinct()


@query("SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS digest FROM customer")
def scl_hash(t: _T) -> DataFrame:
    return t("customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def scl_json(t: _T) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT status, CASE WHEN s IN ('accepted', 'valid', 'provisionally accepted', 'reference') THEN 'accepted' WHEN s IN ('synonym', 'unaccepted', 'invalid', 'misapplied', 'superseded', 'deprecated') THEN 'synonym' WHEN s IN ('unknown', 'uncertain', 'doubtful', 'incertae sedis', 'quarantined', '') THEN 'uncertain' ELSE 'other' END AS class, count(*) AS n FROM (SELECT status, lower(trim(coalesce(status, ''))) AS s FROM taxa) GROUP BY 1, 2")
def scl_status(t: _T) -> DataFrame:
    s = F.col("status")
    kind = F.when(X.is_accepted(s), "accepted").when(X.is_synonym(s), "synonym").when(X.is_uncertain(s), "uncertain").otherwise("other")
    return t("taxa").groupBy("status", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rank, CAST(CASE rank WHEN 'genus' THEN 23 WHEN 'species' THEN 29 WHEN 'subspecies' THEN 30 END AS INTEGER) AS place, CASE rank WHEN 'genus' THEN 'subtribe' WHEN 'species' THEN 'subseries' WHEN 'subspecies' THEN 'species' END AS above, count(*) AS n FROM taxa GROUP BY 1")
def scl_ranks(t: _T) -> DataFrame:
    r = F.col("rank")
    return t("taxa").groupBy("rank", X.rank_order(r).alias("place"), X.rank_neighbour(r, -1).alias("above")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT speciedex_id, concat_ws(' > ', nullif(trim(phylum), ''), nullif(trim(order_name), '')) AS path FROM taxa")
def scl_lineage(t: _T) -> DataFrame:
    return t("taxa").select("speciedex_id", X.lineage_path(X.lineage({"order": F.col("order_name"), "phylum": F.col("phylum")})).alias("path")).distinct()


@query(r"SELECT DISTINCT authorship, CAST(nullif(regexp_extract(authorship, '\b(1[5-9]\d{2}|20\d{2})[a-z]?\b', 1), '') AS INTEGER) AS year FROM taxa WHERE authorship IS NOT NULL")
def scl_year(t: _T) -> DataFrame:
    return t("taxa").where("authorship is not null").select("authorship", X.year_of(F.col("authorship")).alias("year")).distinct()


@query("SELECT provider, round(1e0 * greatest(0.0, least(1.0, CASE WHEN trust >= 3 THEN 1.0 ELSE 0.4 END - least(0.4, (6 - trust) * 0.05) - CASE WHEN trust * 1500 > 5000 THEN 0.3 WHEN trust * 1500 > 2000 THEN 0.2 WHEN trust * 1500 > 1000 THEN 0.1 ELSE 0.0 END)), 6) AS score FROM providers")
def scl_health(t: _T) -> DataFrame:
    p = F.col("trust")
    return t("providers").select("provider", F.round(X.health_score(F.lit(True), p >= 3, F.lit(None).cast("double"), 6 - p, p * 1500), 6).alias("score"))


@query("SELECT n_name, r_name, levenshtein(lower(n_name), lower(r_name))::INTEGER AS distance FROM nation JOIN region ON n_regionkey = r_regionkey")
def scl_levenshtein(t: _T) -> DataFrame:
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.levenshtein(F.lower("n_name"), F.lower("r_name")).alias("distance"))


# --- space and graphs -------------------------------------------------------------------------------------------
def _points(t: _T) -> DataFrame:
    return t("orders").select("o_orderkey", ((F.col("o_custkey") % 170) - 85).cast("double").alias("lat"), (((F.col("o_orderkey") * 7) % 360) - 180).cast("double").alias("lng"))


_POINTS = "(SELECT o_orderkey, (o_custkey % 170 - 85)::DOUBLE AS lat, ((o_orderkey * 7) % 360 - 180)::DOUBLE AS lng FROM orders)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48) / 2), 2) + cos(radians(48)) * cos(radians(lat)) * pow(sin(radians(lng - 11) / 2), 2))))"


@query(f"SELECT o_orderkey, round({_HAV}, 4) AS distance_km FROM {_POINTS} WHERE {_HAV} <= 1500")
def geo_within(t: _T) -> DataFrame:
    return _r(geo.within(_points(t), 48, 11, 1500, ["o_orderkey"]).select("o_orderkey", "distance_km"), 4)


@query(f"SELECT floor(lat / 10 + 0.5) * 10 AS cell_lat, floor(lng / 10 + 0.5) * 10 AS cell_lng, count(*) AS count, round(avg(lat), 6) AS lat FROM {_POINTS} GROUP BY 1, 2")
def geo_clusters(t: _T) -> DataFrame:
    return _r(geo.clusters(_points(t), -1).select("cell_lat", "cell_lng", "count", "lat"))


@query(f"SELECT CAST(least(35, floor((90 - lat) / 180 * 36)) AS INTEGER) AS row, CAST(least(35, floor((lng + 180) / 360 * 36)) AS INTEGER) AS col, count(*)::DOUBLE AS weight, round(count(*) / max(count(*)) OVER (), 6) AS share FROM {_POINTS} GROUP BY 1, 2")
def geo_grid(t: _T) -> DataFrame:
    return geo.density_grid(_points(t), 36)


@query(f"SELECT o_orderkey FROM {_POINTS} WHERE lat BETWEEN -20 AND 20 AND (lng >= 170 OR lng <= -170)")
def geo_box(t: _T) -> DataFrame:
    return _points(t).where(geo.in_box(-20, 170, 20, -170)).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_POINTS} WHERE lat >= 0 AND lat < 60 AND (lng < 0) <> (lng < 60 - lat)")
def geo_polygon(t: _T) -> DataFrame:
    return _points(t).where(geo.in_polygon([(0.0, 0.0), (60.0, 0.0), (0.0, 60.0)])).select("o_orderkey")


@query(f"SELECT count(*) AS points, round(degrees(atan2(avg(sin(radians(lat))), sqrt(pow(avg(cos(radians(lat)) * cos(radians(lng))), 2) + pow(avg(cos(radians(lat)) * sin(radians(lng))), 2)))), 4) AS lat FROM {_POINTS}")
def geo_centroid(t: _T) -> DataFrame:
    return _r(geo.centroid(_points(t)).select("points", "lat"), 4)


@query("SELECT o_orderkey, CASE WHEN s = 0 THEN 'winter' WHEN s = 1 THEN 'spring' WHEN s = 2 THEN 'summer' ELSE 'autumn' END AS season FROM (SELECT o_orderkey, CASE WHEN o_custkey % 170 - 85 < 0 THEN ((month(o_orderdate) % 12) // 3 + 2) % 4 ELSE (month(o_orderdate) % 12) // 3 END AS s FROM orders)")
def geo_season(t: _T) -> DataFrame:
    return t("orders").select("o_orderkey", geo.season(F.month("o_orderdate"), (F.col("o_custkey") % 170) - 85).alias("season"))


def _hierarchy(t: _T) -> tuple[DataFrame, DataFrame]:
    links = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("up")).unionByName(t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("up")))
    links = links.unionByName(t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("up"))).unionByName(t("region").limit(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("up")))
    return links, t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_acctbal").alias("value"))


@query("""WITH c AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT r_regionkey, count(n_nationkey) AS nations, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(greatest(n, 1)), 1)::BIGINT AS leaves FROM region LEFT JOIN c ON n_regionkey = r_regionkey GROUP BY 1)
SELECT 'c' || c_custkey AS node, CAST(3 AS BIGINT) AS depth, CAST(1 AS BIGINT) AS leaves, CAST(0 AS BIGINT) AS descendants FROM customer UNION ALL SELECT 'n' || n_nationkey, 2, greatest(n, 1), n FROM c UNION ALL SELECT 'r' || r_regionkey, 1, leaves, nations + n FROM r UNION ALL SELECT 'world', 0, sum(leaves)::BIGINT, (count(*) + sum(nations) + sum(n))::BIGINT FROM r""")
def geo_tree(t: _T) -> DataFrame:
    return graph.tree_metrics(_hierarchy(t)[0]).select("node", "depth", "leaves", "descendants")


@query("SELECT 's' || s_nationkey AS source, 'c' || c_nationkey AS target, round(sum(l_quantity), 2) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def geo_sankey(t: _T) -> DataFrame:
    nodes = t("nation").select(F.concat(F.lit("s"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(0.0).alias("weight"))
    nodes = nodes.unionByName(t("nation").select(F.concat(F.lit("c"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit(0.0).alias("weight")))
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = j.groupBy(F.concat(F.lit("s"), "s_nationkey").alias("source"), F.concat(F.lit("c"), "c_nationkey").alias("target"), F.lit("flow").alias("type")).agg(F.sum("l_quantity").alias("value"))
    return graph.build_graph(nodes, edges)[1].select("source", "target", F.round("value", 2).alias("value"))


# --- resolution -------------------------------------------------------------------------------------------------
@query("SELECT code, severity, count(*) AS count FROM (SELECT unnest(list_filter([CASE WHEN sha256(assertion_json) <> assertion_hash THEN 'assertion_hash_mismatch' END, CASE WHEN trim(coalesce(provider, '')) = '' THEN 'assertion_provider_missing' END, CASE WHEN trim(coalesce(provider_id, '')) = '' THEN 'assertion_provider_id_missing' END, CASE WHEN trim(coalesce(speciedex_id, '')) = '' THEN 'speciedex_id_missing' END, CASE WHEN trim(speciedex_id) <> '' AND NOT regexp_matches(speciedex_id, '^spx:sha256:[0-9a-f]{64}$') THEN 'speciedex_id_invalid_format' END], lambda x: x IS NOT NULL)) AS code, 'error' AS severity FROM assertions) GROUP BY 1, 2")
def res_assertions(t: _T) -> DataFrame:
    return resolve.issue_summary(resolve.issues(t("assertions"), ["provider", "provider_id"], resolve.assertion_rules()))


@query()
def res_taxa(t: _T) -> DataFrame:
    return resolve.issues(t("provider_taxa"), ["provider", "provider_id"], resolve.taxon_rules())


@query("SELECT provider_id, 'batch_duplicate_source_id' AS code, count(*) AS count FROM provider_taxa GROUP BY provider, provider_id HAVING count(*) > 1")
def res_batch(t: _T) -> DataFrame:
    return resolve.batch_rules(t("provider_taxa"))


@query()
def res_reconcile(t: _T) -> DataFrame:
    return resolve.reconcile(t("provider_taxa"), t("taxa"), t("source_ids"))


@query()
def res_duplicates(t: _T) -> DataFrame:
    return resolve.cluster_summary(resolve.duplicate_pairs(t("taxa"), providers=t("assertions"), synonyms=t("synonyms")))


# --- lists, documents and streams -------------------------------------------------------------------------------
_LIST = lists.ListSpec(text=["scientific_name"], equal=["rank", "kingdom", "family"], ranges=["line_number"], date="loaded_at", sorts=["line_number"], tie=["speciedex_id", "loaded_at"])


@query("SELECT speciedex_id, line_number, loaded_at FROM taxa WHERE lower(rank) = 'species' AND lower(kingdom) = 'fungi' AND line_number >= 100 AND loaded_at >= TIMESTAMP '2024-06-01' AND loaded_at <= TIMESTAMP '2025-06-01 23:59:59.999' ORDER BY line_number DESC NULLS LAST, speciedex_id, loaded_at LIMIT 200")
def flt_list(t: _T) -> DataFrame:
    return lists.query_list(t("taxa"), _LIST, rank="Species", kingdom="FUNGI", min_line_number=100, date_from="2024-06-01", date_to="2025-06-01", sort="line_number", direction="desc", limit=200).select("speciedex_id", "line_number", "loaded_at")


@query("SELECT doc_id FROM documents WHERE n_chars IS NULL OR (CASE WHEN n_chars > 1 THEN n_chars / 100 ELSE n_chars END) <= 2.5")
def flt_low_confidence(t: _T) -> DataFrame:
    return t("documents").where(lists.low_confidence(F.col("n_chars"), 2.5)).select("doc_id")


@query("SELECT provider, provider_id FROM assertions WHERE coalesce(epoch_us(TIMESTAMP '2025-09-01') - epoch_us(loaded_at) > 90 * 24 * 3600000000, TRUE)")
def flt_stale(t: _T) -> DataFrame:
    return t("assertions").where(lists.stale(F.col("loaded_at").cast("timestamp"), "2025-09-01 00:00:00", 90 * 24)).select("provider", "provider_id")


@query("SELECT speciedex_id, count(*) AS n FROM taxa WHERE lower(class_name) = 'nubrodrigaaria' GROUP BY 1")
def flt_by_class(t: _T) -> DataFrame:
    return t("taxa").where(lists.by_rank("class", "Nubrodrigaaria")).groupBy("speciedex_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'k' AS path, props->>'$.k' AS value FROM events")
def prj_flatten(t: _T) -> DataFrame:
    return lists.flatten_paths(t("events"), "event_id", "props")


@query("SELECT lower(synonym_key) AS synonym_key, speciedex_id, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers, count(*) AS records, round(avg(length(provider)), 6) AS confidence FROM synonyms WHERE synonym_key IS NOT NULL GROUP BY 1, 2")
def agg_conflicts(t: _T) -> DataFrame:
    rows = t("synonyms").where("synonym_key is not null").select(F.lower("synonym_key").alias("synonym_key"), "speciedex_id", "provider", F.length("provider").alias("c"))
    return lists.conflict_values(rows, ["synonym_key"], "speciedex_id", "provider", "c")


@query("WITH f AS (SELECT provider, provider_id, min(retrieved_at) AS r FROM provider_taxa GROUP BY 1, 2) SELECT p.provider, p.provider_id, p.retrieved_at, p.retrieved_at <> f.r AS duplicate FROM provider_taxa p JOIN f ON f.provider = p.provider AND f.provider_id = p.provider_id")
def res_scan(t: _T) -> DataFrame:
    return lists.scan_jobs(t("provider_taxa"), ["provider", "provider_id"], "retrieved_at", "canonical_name", "rank").select("provider", "provider_id", "retrieved_at", "duplicate")


@query("SELECT provider, CASE max(CASE WHEN trust <= 1 THEN 3 WHEN trust = 2 THEN 2 WHEN trust = 3 THEN 1 ELSE 0 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'unknown' ELSE 'ok' END AS status FROM providers GROUP BY 1")
def res_health(t: _T) -> DataFrame:
    p = F.col("trust")
    return resolve.worst_status(t("providers").withColumn("s", F.when(p <= 1, "critical").when(p == 2, "warning").when(p == 3, "unknown").otherwise("ok")), "provider", "s")


@query("SELECT volume_file, CAST(floor(coalesce(sum(length(record_json)) OVER (PARTITION BY volume_file ORDER BY line_number, speciedex_id, loaded_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 100000) AS BIGINT) AS volume, line_number FROM taxa WHERE record_json IS NOT NULL QUALIFY row_number() OVER (PARTITION BY volume_file, line_number) >= 1")
def snk_volumes(t: _T) -> DataFrame:
    rows = t("taxa").where("record_json is not null").withColumn("_line", F.col("line_number"))
    rows = rows.withColumn("line_number", F.struct("line_number", "speciedex_id", "loaded_at"))
    return archive.volumes(rows, F.length("record_json"), 100_000).select("volume_file", "volume", F.col("_line").alias("line_number"))


@query("SELECT provider, count(*) AS samples, round(avg(CASE WHEN provider_id LIKE '%7%' THEN 1 ELSE 0 END), 6) AS uptime, round(quantile_cont(length(provider_id), 0.95), 6) AS latency_p95 FROM assertions WHERE loaded_at >= TIMESTAMP '2025-01-01' GROUP BY 1")
def win_health(t: _T) -> DataFrame:
    h = timeline.rolling_health(t("assertions"), "provider", "loaded_at", F.col("provider_id").contains("7"), F.length("provider_id").cast("double"), "2025-01-01 00:00:00")
    return _r(h.select("provider", "samples", "uptime", "latency_p95"))


@query(r"SELECT n_name FROM nation ORDER BY CAST(regexp_extract(n_name, '\d+') AS INTEGER) DESC LIMIT 10")
def ord_natural(t: _T) -> DataFrame:
    return t("nation").orderBy(C.natural_key(F.col("n_name")).desc()).limit(10).select("n_name")


def _events_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)


def str_latest(spark: SparkSession, d: str) -> DataFrame:
    """Incremental upsert of the newest event of each user from a file stream, all that is there."""
    out = shared_folder(spark, "stream")
    streams.run_available(_events_stream(spark, d).select("user_id", "event_id", "event_type", "ts"), out + "-offsets", streams.upsert_batches(out, ["user_id"], ["ts", "event_id"]))
    return streams.latest_version(spark, out).select("user_id", "event_id", "event_type", "ts")


def str_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows of a file stream, appended once the watermark has passed or, at the end, updated."""
    out = shared_folder(spark, "windows")
    counted = streams.windowed_counts(_events_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "0 seconds")

    def each(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/b{n}")

    streams.run_available(counted, out + "-offsets", each, "update")
    rows = spark.read.parquet(f"{out}/*")
    return rows.groupBy("start", "event_type").agg(F.max_by("count", "batch").alias("count"))


QUERIES |= {"str_latest": str_latest, "str_windows": str_windows}
ORACLE["str_latest"] = ORACLE["win_latest"]
ORACLE["str_windows"] = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2"


# --- posting lists and scales -----------------------------------------------------------------------------------
@query("""SELECT p_partkey, CAST(CASE WHEN n = 'small ring' THEN 20 ELSE CASE WHEN n LIKE 'small ring%' THEN 12 ELSE 0 END + CASE WHEN n LIKE '%small ring%' THEN 8 ELSE 0 END + CASE WHEN list_contains(w, 'small') THEN 3 ELSE 0 END + CASE WHEN list_contains(w, 'ring') THEN 3 ELSE 0 END END AS BIGINT) AS score
FROM (SELECT p_partkey, lower(p_name) AS n, regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+') AS w FROM part) WHERE list_contains(w, 'small') AND list_contains(w, 'ring') ORDER BY score DESC, p_partkey LIMIT 200""")
def srh_index(t: _T) -> DataFrame:
    return indexes.index_search(t("part"), "p_partkey", "small ring", ["p_name"], fuzzy=False, limit=200).select("p_partkey", "score")


@query("SELECT * FROM (SELECT p_partkey, round(CASE WHEN n = 'ring' THEN 50.0 ELSE 0.0 END + CASE WHEN list_contains(w, 'ring') THEN 10.0 WHEN len(list_filter(w, lambda x: x LIKE 'ring%')) > 0 THEN 6.5 ELSE 0.0 END + CASE WHEN n = 'sm' THEN 50.0 ELSE 0.0 END + CASE WHEN list_contains(w, 'sm') THEN 10.0 WHEN len(list_filter(w, lambda x: x LIKE 'sm%')) > 0 THEN 6.5 ELSE 0.0 END, 3)::DOUBLE AS score FROM (SELECT p_partkey, lower(p_name) AS n, regexp_split_to_array(lower(p_name), '[^a-z0-9._:-]+') AS w FROM part)) WHERE score > 0")
def srh_union(t: _T) -> DataFrame:
    return indexes.union_search(t("part"), "p_partkey", "ring sm", ["p_name"])


@query("SELECT speciedex_id, count(*) AS n FROM taxa WHERE coalesce(contains(lower(scientific_name), 'glad'), FALSE) OR coalesce(contains(lower(canonical_name), 'glad'), FALSE) GROUP BY 1")
def srh_name_union(t: _T) -> DataFrame:
    df = t("taxa").drop("name")
    comp = searchlang.Compiler(df, ["scientific_name"], fuzzy=False)
    return df.where(comp.match(searchlang.parse("name:glad"))).groupBy("speciedex_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events), c AS (SELECT CAST(least(59, floor((epoch_us(ts) - a) / (b - a) * 60)) AS INTEGER) AS bucket, count(*)::DOUBLE AS value FROM events, s GROUP BY 1) SELECT bucket, value, round(value / max(value) OVER (), 6) AS share FROM c")
def win_slider(t: _T) -> DataFrame:
    return indexes.slider(t("events"), "ts")


@query("SELECT p_partkey, (SELECT count(*) FROM (SELECT unnest(quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8])) AS c FROM part) WHERE c < p.p_retailprice)::DOUBLE AS scaled FROM part p")
def scl_quantiles(t: _T) -> DataFrame:
    return indexes.heat_scale(t("part"), "p_retailprice", "quantile").select("p_partkey", "scaled")


@query("SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled FROM part")
def scl_heat(t: _T) -> DataFrame:
    return _r(indexes.heat_scale(t("part"), "p_retailprice").select("p_partkey", "scaled"))


@query("SELECT event_id FROM events WHERE abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) <= 6 * 3600000000")
def flt_time_window(t: _T) -> DataFrame:
    return t("events").where(indexes.within_window(F.col("ts").cast("timestamp"), "2024-01-15 12:00:00", 12)).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, sum(event_id % 100) OVER (ORDER BY ts DESC, event_id) AS s FROM events) WHERE s > 200000")
def ext_evict(t: _T) -> DataFrame:
    return indexes.evict(t("events").withColumn("bytes", F.col("event_id") % 100), "bytes", "ts", 200_000, ["event_id"]).select("event_id")


@query("SELECT event_type, max(ts) AS newest, CASE WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) > 48 * 3600000000 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY 1")
def res_freshness(t: _T) -> DataFrame:
    return indexes.freshness(t("events"), "event_type", "ts", "2024-02-01 00:00:00").select("event_type", "newest", "status")


@query("SELECT 'orphan_source_ids' AS \"check\", count(*) AS count FROM source_ids WHERE speciedex_id IS NOT NULL AND speciedex_id NOT IN (SELECT speciedex_id FROM taxa) UNION ALL SELECT 'orphan_synonyms', count(*) FROM synonyms WHERE speciedex_id IS NOT NULL AND speciedex_id NOT IN (SELECT speciedex_id FROM taxa) UNION ALL SELECT 'missing_key', count(*) FILTER (WHERE trim(coalesce(speciedex_id, '')) = '') FROM taxa UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT speciedex_id FROM taxa GROUP BY 1 HAVING count(*) > 1)")
def res_verify(t: _T) -> DataFrame:
    return indexes.verify_index(t("taxa"), {"source_ids": t("source_ids"), "synonyms": t("synonyms")})
