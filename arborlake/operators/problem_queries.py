"""Queries of the general problems over the tables of the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import flatten, hierarchy, orphans
from arborlake.session import table


def _links(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "iconforge_taxa")
    return hierarchy.current_links(rows, "taxon_key", "parent_key", "accepted_key", "updated_at", F.col("indexed_at"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, d)).where("cycle_key is not null").select(F.col("node").alias("taxon_key"), "cycle_key")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = hierarchy.resolve(_links(spark, d), with_paths=True).where("path is not null")
    return rows.select(F.col("node").alias("taxon_key"), F.col("root").alias("root_key"), "depth", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(_links(spark, d), with_paths=True))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (tab, key, text, steps) in flatten.FIELDS.items():
        part = flatten.nested_items(table(spark, d, tab), key, text, steps).select(F.lit(name).alias("json_field"), "record_key", "outer_pos", "inner_pos", "item")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """All nested records as linked flat rows."""
    out = None
    for name, (tab, key, text, _) in flatten.FIELDS.items():
        part = flatten.tables(table(spark, d, tab), key, text).select(F.lit(name).alias("json_field"), "record_key", "path", "row_key", "parent_key", "pos", F.to_json("fields").alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    states = orphans.parent_states(table(spark, d, "taxa"), F.col("speciedex_id"), F.col("loaded_at"), F.col("status"))
    refs = orphans.union([orphans.references(table(spark, d, t), t, i) for t, i in (("source_ids", "provider_id"), ("synonyms", "synonym_key"), ("assertions", "provider_id"))])
    return refs, orphans.orphans(refs, states)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)[1].select("ref_table", "provider", "ref_id", "speciedex_id").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_orphans(spark, d))


_LINKS_SQL = r"""
ats AS (SELECT *, coalesce(try_cast(CASE WHEN regexp_matches(t, '(Z|[+-]\d\d:\d\d)$') THEN t ELSE t || 'Z' END AS timestamptz), timestamptz '0001-01-01 00:00:00Z') AS upd FROM
  (SELECT *, regexp_replace(regexp_replace(upper(trim(updated_at)), '^(\d{4})(\d\d)(\d\d)T', '\1-\2-\3T'), 'T(\d\d)(\d\d)(\d\d)', 'T\1:\2:\3') AS t FROM iconforge_taxa)),
cur AS (SELECT taxon_key AS node, CASE WHEN trim(coalesce(accepted_key, '')) <> '' AND accepted_key <> taxon_key THEN accepted_key WHEN trim(coalesce(parent_key, '')) <> '' THEN parent_key END AS up
  FROM ats WHERE trim(coalesce(taxon_key, '')) <> '' QUALIFY row_number() OVER (PARTITION BY taxon_key ORDER BY upd DESC, indexed_at DESC, up DESC NULLS LAST) = 1),
way AS (SELECT node AS start, node AS cur_node, up, [node] AS seen, FALSE AS loop FROM cur
  UNION ALL SELECT w.start, c.node, c.up, list_append(w.seen, c.node), list_contains(w.seen, c.node) FROM way w JOIN cur c ON c.node = w.up WHERE NOT w.loop),
"""
_PATHS_SQL = _LINKS_SQL + " ends AS (SELECT w.* FROM way w WHERE NOT w.loop AND (w.up IS NULL OR NOT EXISTS (SELECT 1 FROM cur c WHERE c.node = w.up)))"
_REFS_SQL = """
p AS (SELECT CASE WHEN x LIKE 'spx:sha256:%' THEN trim(substr(x, 12)) ELSE x END AS k, loaded_at, lower(trim(coalesce(status, ''))) = 'deleted' AS gone FROM (SELECT lower(trim(speciedex_id)) AS x, loaded_at, status FROM taxa) WHERE x <> ''),
st AS (SELECT k, min(loaded_at) AS first_seen, bool_and(gone) FILTER (WHERE loaded_at = latest) AS deleted FROM (SELECT *, max(loaded_at) OVER (PARTITION BY k) AS latest FROM p) GROUP BY k),
r AS (SELECT 'source_ids' AS ref_table, provider, provider_id AS ref_id, speciedex_id, loaded_at FROM source_ids UNION ALL SELECT 'synonyms', provider, synonym_key, speciedex_id, loaded_at FROM synonyms
  UNION ALL SELECT 'assertions', provider, provider_id, speciedex_id, loaded_at FROM assertions),
rk AS (SELECT *, CASE WHEN x LIKE 'spx:sha256:%' THEN trim(substr(x, 12)) ELSE x END AS k FROM (SELECT *, lower(trim(speciedex_id)) AS x FROM r) WHERE x <> ''),
j AS (SELECT rk.*, CASE WHEN st.k IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN first_seen > rk.loaded_at THEN 'early' END AS why FROM rk LEFT JOIN st ON st.k = rk.k)
"""
_WALK = {
    "taxa.record_json": ("taxa", "speciedex_id", "record_json", "d->'history'", "e->'sources'", ["provider_id", "providerId"]),
    "assertions.assertion_json": ("assertions", "assertion_hash", "assertion_json", "d->'extra'->'distribution'", "e->'areas'", ["code"]),
    "iconforge_taxa.lineage_json": ("iconforge_taxa", "taxon_key", "lineage_json", "d", "e->'metadata'->'alternates'", ["name"]),
}


def _walk_sql(name: str) -> str:
    tab, key, col, outer, inner, fields = _WALK[name]
    def once(x: str) -> str:
        return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x}->>'$') THEN ({x}->>'$')::JSON ELSE {x} END"
    def listed(x: str) -> str:
        return f"CASE json_type({x}) WHEN 'ARRAY' THEN CAST({x} AS JSON[]) ELSE [{x}] END"
    got = ", ".join(f"i->>'{f}'" for f in fields)
    return f"""
SELECT DISTINCT '{name}' AS json_field, record_key, outer_pos, inner_pos, item FROM (
 SELECT record_key, outer_pos, CAST(ip - 1 AS INTEGER) AS inner_pos, CASE json_type(i) WHEN 'OBJECT' THEN coalesce({got}) WHEN 'VARCHAR' THEN i->>'$' END AS item FROM (
  SELECT record_key, outer_pos, unnest(il) AS i, generate_subscripts(il, 1) AS ip FROM (
   SELECT record_key, outer_pos, {listed('q')} AS il FROM (
    SELECT record_key, CAST(op - 1 AS INTEGER) AS outer_pos, {inner} AS q FROM (
     SELECT record_key, unnest(ol) AS e, generate_subscripts(ol, 1) AS op FROM (
      SELECT record_key, {listed('o')} AS ol FROM (
       SELECT record_key, {once('o')} AS o FROM (
        SELECT record_key, {outer} AS o FROM (
         SELECT record_key, {once('d')} AS d FROM (SELECT {key} AS record_key, CASE WHEN json_valid({col}) THEN {col}::JSON END AS d FROM {tab}) WHERE d IS NOT NULL)) WHERE o IS NOT NULL)))) WHERE q IS NOT NULL)))
WHERE trim(item) <> ''"""


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_tables, p4_found, p4_report)}
ORACLE = {
    "p2_found": "WITH RECURSIVE " + _LINKS_SQL + " loops AS (SELECT start, list_min(seen[list_position(seen, cur_node):]) AS cycle_key FROM way WHERE loop) SELECT start AS taxon_key, cycle_key FROM loops",
    "p2_paths": "WITH RECURSIVE " + _PATHS_SQL + " SELECT start AS taxon_key, cur_node AS root_key, CAST(len(seen) - 1 AS BIGINT) AS depth, array_to_string(list_reverse(seen), ' > ') AS path FROM ends",
    "p2_descendants": "WITH RECURSIVE " + _PATHS_SQL + " SELECT seen[n + 1] AS ancestor, start AS descendant, CAST(n AS BIGINT) AS distance FROM (SELECT start, seen, unnest(range(1, len(seen))) AS n FROM ends)",
    "p3_found": " UNION ALL ".join(_walk_sql(k) for k in _WALK),
    "p4_found": "WITH " + _REFS_SQL + " SELECT DISTINCT ref_table, provider, ref_id, speciedex_id FROM j WHERE why IS NOT NULL",
    "p4_report": "WITH " + _REFS_SQL + " SELECT ref_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS refs, count(why) AS orphans, count(*) FILTER (WHERE why = 'missing') AS missing, count(*) FILTER (WHERE why = 'deleted') AS deleted, count(*) FILTER (WHERE why = 'early') AS early FROM j GROUP BY ALL",
}
