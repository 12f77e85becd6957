"""Archive aggregates, joins and keyed upserts over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Status classes.
ACCEPTED = ["accepted", "valid", "provisionally accepted", "reference"]
SYNONYM = ["synonym", "unaccepted", "invalid", "misapplied", "superseded", "deprecated"]
UNCERTAIN = ["unknown", "uncertain", "doubtful", "incertae sedis", "quarantined"]
ACTIVE = ["accepted", "valid", "provisionally accepted", "unknown", "reference"]


def counts(df: DataFrame, by: str, where: Column | None = None, blank: str | None = None) -> DataFrame:
    """by, count: count desc, value asc; blank values are left out, or named."""
    rows = df if where is None else df.where(where)
    v = F.coalesce(F.trim(F.col(by)), F.lit(""))
    rows = rows.withColumn(by, F.when(v == "", blank).otherwise(v) if blank else v)
    rows = rows if blank else rows.where(F.col(by) != "")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), by)


def provider_statistics(source_ids: DataFrame, assertions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """provider with its counts in three tables; missing is 0. One union and one aggregate instead of two outer joins."""
    frames = [f.select("provider", *[F.lit(int(i == j)).alias(n) for j, n in enumerate(("source_ids", "assertions", "synonyms"))]) for i, f in enumerate((source_ids, assertions, synonyms))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("provider").agg(*[F.sum(n).alias(n) for n in ("source_ids", "assertions", "synonyms")])


def lineage_count(df: DataFrame, rank: str, column: str) -> DataFrame:
    """Names of a rank: those of the rank's own rows together with all filled values of the lineage column."""
    own = df.where(F.lower("rank") == rank).select(F.col("canonical_name").alias("name"))
    seen = df.select(F.col(column).alias("name"))
    return own.unionByName(seen).where("trim(name) <> ''").distinct().agg(F.count(F.lit(1)).alias("count"))


def newest(df: DataFrame, keys: list[str], when: str = "loaded_at") -> DataFrame:
    """One row a key: the latest, of equal ones that with the greatest text; the same whatever the partitioning."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*([when] if when in rest else []), F.to_json(F.struct(*sorted(rest)), {"ignoreNullFields": "false"}))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_m")).select(*keys, "_m.*") if rest else df.distinct()


def status_fold(assertions: DataFrame, taxa: DataFrame, key: str = "speciedex_id") -> DataFrame:
    """provider, accepted, synonym, unknown over assertions joined with taxa; reference falls to unknown."""
    s = F.lower(F.trim(F.col("status")))
    kind = F.when(s.isin("accepted", "valid", "provisionally accepted"), "accepted").when(s.isin(SYNONYM), "synonym").otherwise("unknown")
    one = newest(taxa.select(key, kind.alias("kind"), *[c for c in ("loaded_at",) if c in taxa.columns]), [key]).select(key, "kind")
    j = assertions.select("provider", key).join(one, key)
    return j.groupBy("provider").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("accepted", "synonym", "unknown")])


def synonym_lookup(synonyms: DataFrame, taxa: DataFrame, key: str, filters: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """Taxa of a synonym key: providers joined by commas in order and their number; number desc, id."""
    hit = synonyms.where(F.lower(F.trim("synonym_key")) == key.strip().lower()).join(newest(taxa, ["speciedex_id"]).drop("provider", "loaded_at"), "speciedex_id")
    for c, v in (filters or {}).items():
        hit = hit.where(F.lower(F.col(c)) == v.lower())
    return hit.groupBy("speciedex_id", "canonical_name", "rank").agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.count_distinct("provider").alias("provider_count")).orderBy(F.desc("provider_count"), "speciedex_id").limit(limit)


def ambiguous(df: DataFrame, key: str, target: str) -> DataFrame:
    """key, n of keys that lead to more than one target; n desc, key."""
    return df.groupBy(key).agg(F.count_distinct(target).alias("n")).where("n > 1").orderBy(F.desc("n"), key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key over both; the map side keeps one row a key before the shuffle. At equal order the incoming row wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("m")).select(*keys, "m.*").drop("_new")


def attach_assertions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assertions after the upsert, revision events): an event only where a hash was there and differs."""
    keys = ["provider", "provider_id"]
    j = new.join(old.select(*keys, F.col("assertion_hash").alias("previous_assertion_hash")), keys)
    events = j.where(F.col("previous_assertion_hash") != F.col("assertion_hash")).select(F.lit("revised").alias("event"), "speciedex_id", *keys, F.col("updated_at").alias("changed_at"), "previous_assertion_hash", "assertion_hash", F.col("assertion_json").alias("assertion"))
    return upsert(old, new, keys, ["updated_at"]), events


def replace_synonyms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Synonyms of each (taxon, provider) in new take the place of the old ones; distinct."""
    keys = ["speciedex_id", "provider"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(old.columns)).dropDuplicates(["synonym_key", *keys])


def insert_new(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows refused because their key is there already or twice in the batch; the first by its text is taken)."""
    w = Window.partitionBy(key).orderBy(F.to_json(F.struct(*sorted(new.columns)), {"ignoreNullFields": "false"}))
    numbered = new.withColumn("_n", F.row_number().over(w))
    fresh = numbered.join(old.select(key).distinct(), key, "left_anti").where("_n = 1").drop("_n")
    refused = numbered.join(old.select(key).distinct(), key, "left_semi").drop("_n").unionByName(numbered.join(old.select(key).distinct(), key, "left_anti").where("_n > 1").drop("_n"))
    return fresh.select(new.columns), refused.select(new.columns)


def open_conflicts(conflicts: DataFrame, *closed: DataFrame) -> DataFrame:
    """Conflicts without a resolution or rejection event."""
    for events in closed:
        conflicts = conflicts.join(events.select("conflict_id").distinct(), "conflict_id", "left_anti")
    return conflicts


def import_records(index: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, state, event: new is pending/inserted, a changed digest stale/changed, else the old state/unchanged."""
    j = new.select(key, F.col(digest).alias("_new")).join(index.select(key, F.col(digest).alias("_old"), F.col("state").alias("_state")), key, "left")
    return j.select(key, F.when(F.col("_old").isNull(), "pending").when(F.col("_old") != F.col("_new"), "stale").otherwise(F.col("_state")).alias("state"), F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged").alias("event"))


def prune(tables: dict[str, DataFrame], keep: DataFrame, key: str = "speciedex_id") -> dict[str, DataFrame]:
    """Every table reduced to the kept ids."""
    ids = keep.select(key).distinct()
    return {n: t.join(ids, key, "left_semi") for n, t in tables.items()}


def volumes(df: DataFrame, size: Column, target: int) -> DataFrame:
    """Rows with the number of the volume each falls into when volumes are closed at `target` bytes, in order of line_number."""
    before = F.sum(size).over(Window.partitionBy("volume_file").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("volume", F.floor(F.coalesce(before, F.lit(0)) / target))
