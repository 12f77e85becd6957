"""Queries of the llm problems over the tables of the data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import bpe, entities, leaks, pii, survivors, unitext, variants
from arborlake.session import table

NAMES = ["scientific_name", "canonical_name"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unitext.disguises(table(spark, d, "taxa"), "speciedex_id", NAMES).select("speciedex_id", "field_name").distinct()


def p1_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of taxa in its consistent form."""
    looks = unitext.all_looks(spark)
    return table(spark, d, "taxa").select("speciedex_id", *[unitext.canonical_column(F.col(c), looks).alias(c) for c in NAMES]).distinct()


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches with their confidence."""
    return entities.match(table(spark, d, "taxa"), table(spark, d, "provider_taxa"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("speciedex_id", "provider", "provider_id")


def _survive(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return survivors.survive(table(spark, d, "assertions"), table(spark, d, "providers"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best, _, _ = _survive(spark, d)
    return best.where("all_best").select("provider", "provider_id", "assertion_hash").distinct()


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value judged true of every taxon and field."""
    return _survive(spark, d)[1]


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of every taxon, field by field."""
    best, judged, rows = _survive(spark, d)
    return survivors.resolved(rows, best, judged).select("key", "provider", "provider_id", "assertion_hash", F.to_json("record").alias("record"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    taxa = table(spark, d, "taxa").select("speciedex_id", "authorship").where("authorship is not null").distinct()
    links = variants.link(taxa, "authorship", table(spark, d, "authors"), "author_id", "full_name")
    return taxa.join(links, taxa.authorship == links.text).select("speciedex_id", F.col("person").alias("author_id")).distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_pos")


def p10_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    return pii.masked(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_names, p5_found, p5_matches, p6_found, p6_values, p6_records, p7_found, p8_ids, p9_found, p10_found, p10_text)}
_UNKNOWN = ", ".join(f"'{w}'" for w in survivors.UNKNOWN)
_FILLED = " + ".join(f"CAST(trim(coalesce(c->>'{f}', '')) <> '' AND lower(trim(c->>'{f}')) NOT IN ({_UNKNOWN}) AS INTEGER)" for f in survivors.FIELDS)
ORACLE: dict[str, str] = {
    "p6_found": rf"""
WITH a AS (SELECT DISTINCT CASE WHEN x LIKE 'spx:sha256:%' THEN trim(substr(x, 12)) ELSE x END AS k, lower(trim(provider)) AS source, provider, provider_id, assertion_hash, assertion_json, regexp_replace(regexp_replace(upper(trim(updated_at)), '^(\d{{4}})(\d\d)(\d\d)T', '\1-\2-\3T'), 'T(\d\d)(\d\d)(\d\d)', 'T\1:\2:\3') AS t
  FROM (SELECT *, lower(trim(speciedex_id)) AS x FROM assertions) WHERE x <> ''),
j AS (SELECT *, CASE WHEN json_valid(assertion_json) THEN assertion_json::JSON END AS d FROM a),
u AS (SELECT *, CASE WHEN json_type(d) = 'VARCHAR' AND json_valid(d->>'$') THEN (d->>'$')::JSON ELSE d END AS c FROM j),
r AS (SELECT k, u.provider, provider_id, assertion_hash, coalesce(p.trust, -1) AS trust, coalesce({_FILLED}, 0) AS filled,
  coalesce(try_cast(CASE WHEN regexp_matches(t, '(Z|[+-]\d\d:\d\d)$') THEN t ELSE t || 'Z' END AS timestamptz), timestamptz '0001-01-01 00:00:00Z') AS ts FROM u LEFT JOIN providers p ON lower(trim(p.provider)) = source),
s AS (SELECT DISTINCT * FROM r),
m AS (SELECT *, max(trust) OVER w AS mt, max(filled) OVER w AS mf, max(ts) OVER w AS ms, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY k)),
b AS (SELECT *, count(*) OVER (PARTITION BY k) AS ties FROM m WHERE trust = mt AND filled = mf AND ts = ms AND n > 1)
SELECT DISTINCT provider, provider_id, assertion_hash FROM b WHERE ties = 1""",
}
