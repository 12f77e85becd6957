"""Small aggregates over tables, runs, health records and collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.archive import ACTIVE


def table_counts(tables: dict[str, DataFrame], allowed: list[str] | None = None) -> DataFrame:
    """table, rows of each table; a name that is not allowed is refused."""
    if allowed is not None and (bad := sorted(set(tables) - set(allowed))):
        raise ValueError(f"no such tables: {bad}")
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def distinct_by_rank(df: DataFrame, key: str, rank: str = "rank", status: str = "status", active: list[str] = ACTIVE) -> DataFrame:
    """rank, count of distinct ids among rows whose status is active; blank ranks are left out."""
    r = F.lower(F.trim(F.coalesce(F.col(rank), F.lit(""))))
    rows = df.where(F.lower(F.trim(F.col(status))).isin(active)).select(r.alias("rank"), F.col(key).alias("id")).where("rank <> '' and id is not null")
    return rows.distinct().groupBy("rank").agg(F.count(F.lit(1)).alias("count"))


def archive_statistics(taxa: DataFrame, tables: dict[str, DataFrame], key: str = "speciedex_id") -> DataFrame:
    """metric, value: counts by rank of active rows (rank:NAME), rows of each table (table:NAME) and the number of volumes."""
    ranks = distinct_by_rank(taxa, key).select(F.concat(F.lit("rank:"), "rank").alias("metric"), F.col("count").alias("value"))
    totals = table_counts(tables).select(F.concat(F.lit("table:"), "table").alias("metric"), F.col("rows").alias("value"))
    volumes = taxa.agg(F.count_distinct("volume_file").alias("value")).select(F.lit("volumes").alias("metric"), "value")
    return ranks.unionByName(totals).unionByName(volumes)


def event_statistics(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """field, value, count over fields of a JSON column: how many events have each value; a missing value counts as `unknown`."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(F.trim(F.get_json_object(text, f"$.{f}")), F.lit("")), F.lit("unknown")).alias("value")) for f in fields])
    return df.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count(F.lit(1)).alias("count"))


def group_records(df: DataFrame, key: str, records: str) -> DataFrame:
    """key, records, rows: the sum of a record number and the rows of each group, the largest first; blank keys are `unknown`."""
    k = F.coalesce(F.nullif(F.trim(F.col(key).cast("string")), F.lit("")), F.lit("unknown"))
    return df.groupBy(k.alias("key")).agg(F.sum(F.coalesce(F.col(records), F.lit(0))).alias("records"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("records"), "key")


def summarize_health(df: DataFrame, enabled: Column, available: Column, latency: Column, score: Column) -> DataFrame:
    """One row: total, enabled, available and failing records, mean positive latency of enabled ones and mean score."""
    rows = df.select(enabled.alias("e"), available.alias("a"), latency.cast("double").alias("l"), score.cast("double").alias("s"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("e").alias("enabled"), F.count_if(F.col("e") & F.col("a")).alias("available"), F.count_if(F.col("e") & ~F.col("a")).alias("failing"),
        F.avg(F.when(F.col("e") & (F.col("l") > 0), F.col("l"))).alias("latency"), F.avg("s").alias("score"),
    )


def cell_counts(df: DataFrame) -> DataFrame:
    """field, nulls, scalars, objects, arrays: what the cells of each column hold, in one pass."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    aggs = [F.count(F.col(f"`{c}`")).alias(c) for c in kinds]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    pick = lambda c, want: F.when(F.lit(kinds[c] in want), F.col(f"`{c}`")).otherwise(0)
    cells = [F.struct(F.lit(c).alias("field"), (F.col("_n") - F.col(f"`{c}`")).alias("nulls"), pick(c, {k for k in kinds.values() if k not in ("struct", "map", "array")}).alias("scalars"), pick(c, ("struct", "map")).alias("objects"), pick(c, ("array",)).alias("arrays")) for c in kinds]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def merge_metrics(frames: list[DataFrame], labels: list[str]) -> DataFrame:
    """name, labels, total, latest: counters are added up over all frames, gauges (kind `gauge`) keep the last reading."""
    rows = reduce(DataFrame.unionByName, frames)
    return rows.groupBy("name", *labels).agg(F.sum(F.when(F.col("kind") != "gauge", F.col("value"))).alias("total"), F.max_by("value", F.when(F.col("kind") == "gauge", F.struct("at", "value"))).alias("latest"))


def run_summary(df: DataFrame, by: str) -> DataFrame:
    """by, counters, acceptance (created, matched and revised of all fetched) and error_rate; null where nothing was fetched."""
    names = ["fetched", "created", "matched", "revised", "conflicted", "rejected"]
    s = df.groupBy(by).agg(*[F.sum(F.coalesce(F.col(n), F.lit(0))).alias(n) for n in names])
    return s.withColumn("acceptance", F.round(F.try_divide(F.col("created") + F.col("matched") + F.col("revised"), F.col("fetched")), 6)).withColumn("error_rate", F.round(F.try_divide(F.col("rejected"), F.col("fetched")), 6))


def breakdown(df: DataFrame, values: Column) -> DataFrame:
    """value, count of an array column: each record counts once for each of its values."""
    return df.select(F.explode(F.array_distinct(values)).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def chart_bounds(df: DataFrame, value: str) -> DataFrame:
    """low, high of an axis: zero is always within; a flat one is padded by a tenth of its height (by 1 at zero)."""
    b = df.agg(F.least(F.lit(0.0), F.min(F.col(value).cast("double"))).alias("low"), F.greatest(F.lit(0.0), F.max(F.col(value).cast("double"))).alias("high"))
    flat = F.col("low") == F.col("high")
    pad = F.when(F.col("high") == 0, 1.0).otherwise(F.abs(F.col("high")) * 0.1)
    return b.select(F.when(flat, F.col("low") - pad).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + pad).otherwise(F.col("high")).alias("high"))


def discover_fields(df: DataFrame, text: str, bound: int = 512) -> DataFrame:
    """field, records: the top-level keys of a JSON column in how many records, in order of their names, at most `bound`."""
    keys = F.explode(F.json_object_keys(text))
    return df.select(keys.alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("records")).orderBy("field").limit(bound)


def missing(rows: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a counterpart of the same composite key; null parts are equal to each other."""
    other = there.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")


def grid_filter(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows of which any visible column holds the text, without regard to case; a blank query keeps all."""
    want = query.strip().lower()
    return df if not want else df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(want), F.lit(False)) for c in columns]))


def index_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Rows that pass every field: a scalar (equal without case), a list (any of it) or operators $gt $gte $lt $lte $ne $contains $in; others are ignored.

    Numbers compare as numbers and all else as text without case; a missing value only passes $ne.
    """
    def text(c: str) -> Column:
        return F.lower(F.trim(F.col(c).cast("string")))

    def one(c: str, op: str, v) -> Column:
        num = isinstance(v, (int, float)) and not isinstance(v, bool)
        left, right = (F.col(c).cast("string").try_cast("double"), F.lit(float(v))) if num else (text(c), F.lit(str(v).strip().lower()) if not isinstance(v, list) else None)
        tests = {
            "$gt": lambda: left > right, "$gte": lambda: left >= right, "$lt": lambda: left < right, "$lte": lambda: left <= right, "$eq": lambda: left == right, "$ne": lambda: ~F.coalesce(left == right, F.lit(False)),
            "$contains": lambda: text(c).contains(str(v).strip().lower()), "$in": lambda: text(c).isin([str(x).strip().lower() for x in v]),
        }
        return F.coalesce(tests[op](), F.lit(False)) if op in tests else F.lit(True)

    for c, v in spec.items():
        for op, x in (v.items() if isinstance(v, dict) else [("$in", v)] if isinstance(v, list) else [("$eq", v)]):
            df = df.where(one(c, op, x))
    return df


def arrivals(df: DataFrame, received: str, seq: str, since: str | None = None, limit: int = 100) -> DataFrame:
    """The last `limit` records received since a time, newest first."""
    rows = df if since is None else df.where(F.col(received) >= F.lit(since).cast("timestamp"))
    return rows.orderBy(F.desc(seq)).limit(limit)


def map_stack(df: DataFrame, at: Column | None = None, species: str | None = None, provider: str | None = None) -> DataFrame:
    """Points that pass the time condition, then the species and then the provider, each without regard to case; an absent one passes all."""
    rows = df if at is None else df.where(F.coalesce(at, F.lit(False)))
    for c, v in (("species", species), ("provider", provider)):
        rows = rows if not v else rows.where(F.lower(F.trim(F.col(c))) == v.strip().lower())
    return rows


def point_of(text: str) -> list[Column]:
    """Latitude and longitude of a JSON record: the first of the usual names, or a GeoJSON point; null beyond the range of either."""
    at = lambda *names: F.coalesce(*[F.get_json_object(text, f"$.{n}").try_cast("double") for n in names])
    lat, lng = at("lat", "latitude", "decimalLatitude", "y", "coordinates[1]", "geometry.coordinates[1]"), at("lng", "lon", "longitude", "decimalLongitude", "x", "coordinates[0]", "geometry.coordinates[0]")
    ok = lat.between(-90, 90) & lng.between(-180, 180)
    return [F.when(ok, lat).alias("lat"), F.when(ok, lng).alias("lng")]


def chart_order(df: DataFrame, label: str, value: str, how: str) -> DataFrame:
    """Series by value (asc, desc; ties by label) or by label."""
    keys = {"asc": [F.asc_nulls_last(value), label], "desc": [F.desc_nulls_last(value), label], "label": [label]}[how]
    return df.orderBy(*keys)
