"""Keyed reads and rebuilds of archive tables, an updatable inverted index, and whole-record normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import taxonomy as X
from arborlake.functions.keys import filled
from arborlake.operators.archive import newest
from arborlake.plans.searchlang import postings


def read(df: DataFrame, **keys: str) -> DataFrame:
    """The newest row of a key (all rows of a partial key, each once): conditions reach the scan, null and blank keys find nothing."""
    rows = df
    for c, v in keys.items():
        rows = rows.where(F.col(c) == v) if v is not None and str(v).strip() else rows.where(F.lit(False))
    return rows.distinct()


def of_taxon(assertions: DataFrame, taxon: str, providers: list[str] | None = None) -> DataFrame:
    """The newest assertion of each source id of one taxon, perhaps of some providers only."""
    rows = read(assertions, speciedex_id=taxon)
    rows = rows if providers is None else rows.where(F.lower(F.trim("provider")).isin([p.strip().lower() for p in providers]))
    return newest(rows, ["provider", "provider_id"])


def metadata(df: DataFrame, key: str, default: str | None = None) -> str | None:
    """Value of a key of a (key, value) table; the greatest if it repeats, the default if it is absent."""
    row = df.where(F.col("key") == key).agg(F.max("value").alias("v")).first()
    return row.v if row.v is not None else default


def rebuild(records: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """A table anew from JSON records: fields maps columns to paths; records without the first column are left out, of one key the newest by `updated_at` stays."""
    cols = [F.get_json_object(text, "$." + p).alias(c) for c, p in fields.items()]
    key = next(iter(fields))
    rows = records.where(F.try_parse_json(text).isNotNull()).select(*cols).where(filled(F.col(key)))
    return newest(rows, [key], "updated_at")


def index_add(index: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The inverted index with the documents added, or put in place of those of the same key."""
    return index.join(docs.select(key).distinct(), key, "left_anti").unionByName(postings(docs, key, fields).select(index.columns))


def index_remove(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti")


def index_get(index: DataFrame, key: str, value) -> DataFrame:
    """Tokens and counts of one document."""
    return index.where(F.col(key) == value)


def pruned(df: DataFrame, index: DataFrame, key: str, tokens: list[str], test: Column, every: bool = True) -> DataFrame:
    """Rows that pass the test, read only where the index knows all (or any) of the tokens; tokens must be implied by the test."""
    want = list(dict.fromkeys(t.lower() for t in tokens))
    if not want:
        return df.where(test)
    hits = index.where(F.col("token").isin(want)).groupBy(key).agg(F.count_distinct("token").alias("n"))
    keys = hits.where(F.col("n") == len(want)) if every else hits
    return df.join(keys.select(key), key, "left_semi").where(test)


def normalize(df: DataFrame, basic: bool = False) -> DataFrame:
    """Records in their consistent form: names, authorship, rank, status and classification, the canonical name made where it is missing.

    `basic` is the reduced variant: spaces, rank and status only. Other columns stay as they are; null text becomes ''.
    """
    plain = {c: X.space(F.col(c)) for c in ("kingdom", "phylum", "class_name", "order_name", "family", "genus", "provider", "provider_id") if c in df.columns}
    rank = X.rank(F.col("rank"))
    out = {**plain, "rank": rank, "status": X.status(F.col("status")), "scientific_name": X.space(F.col("scientific_name")), "canonical_name": X.space(F.col("canonical_name")), "authorship": X.space(F.col("authorship"))}
    if not basic:
        name, author = X.taxon_name(F.col("scientific_name")), X.authorship(F.col("authorship"))
        given = X.taxon_name(F.col("canonical_name"))
        out |= {"scientific_name": name, "authorship": author, "canonical_name": F.when(given != "", given).otherwise(X.canonical_name(name, author, F.col("rank"))), "rank": F.when(rank == "unranked", X.infer_rank(F.coalesce(F.nullif(given, F.lit("")), name))).otherwise(rank)}
    return df.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in df.columns])


def walk(paths: DataFrame, path: str, match: Column | None = None) -> DataFrame:
    """Nodes of trees in pre-order (a parent before its children, these by name), or those that match, with all that stand above them."""
    rows = paths.where(F.col(path).isNotNull())
    if match is not None:
        above = rows.where(F.coalesce(match, F.lit(False))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.slice(path, F.lit(1), n))).alias("_p")).distinct()
        rows = rows.join(above, rows[path] == above["_p"], "left_semi")
    return rows.orderBy(path)


def overlap_by(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """One row: left, right, both, only_left, only_right and the Jaccard share of two sets of keys that are computed from records; null keys do not count."""
    a, b = left.select(left_key.alias("k")).where("k is not null").distinct(), right.select(right_key.alias("k")).where("k is not null").distinct()
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "k", "full")
    n = j.agg(F.count("l").alias("left"), F.count("r").alias("right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))
    return n.select("*", (F.col("left") - F.col("both")).alias("only_left"), (F.col("right") - F.col("both")).alias("only_right"), F.round(F.coalesce(F.try_divide(F.col("both"), F.col("left") + F.col("right") - F.col("both")), F.lit(0.0)), 6).alias("jaccard"))
