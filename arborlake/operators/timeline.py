"""Time buckets with gap filling and running totals, deltas, trends and other ordered operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.operators.stats import quantiles, with_quantiles

STEPS = {"year": "INTERVAL 1 YEAR", "quarter": "INTERVAL 3 MONTH", "month": "INTERVAL 1 MONTH", "week": "INTERVAL 7 DAY", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR", "minute": "INTERVAL 1 MINUTE"}


def bucket_key(ts: Column, bucket: str) -> Column:
    """Label of the UTC bucket: 2024, 2024-Q1, 2024-01, 2024-W05, 2024-01-05, 2024-01-05T13:00, 2024-01-05T13:45."""
    if bucket == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if bucket == "quarter":
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-Q"), F.quarter(ts).cast("string"))
    return F.date_format(ts, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH:00", "minute": "yyyy-MM-dd'T'HH:mm"}[bucket])


def timeline(df: DataFrame, field: str, bucket: str, by: str | None = None, low: str | None = None, high: str | None = None, fill: bool = False, cumulative: bool = False) -> DataFrame:
    """group, bucket, start, end, count (and running): counts a UTC bucket and series.

    Dates and groups that hold several values count once for each; a `high` of a date only reaches to the end of
    that day; end is the next start less a millisecond; fill adds the empty buckets between the first and last of
    each series.
    """
    kind = C.element_type(C.field_type(df, field))
    rows = df.select(F.explode(C.values(df, field, "drop")).alias("v"), *([C.values(df, by).alias("g")] if by else []))
    ts = C.moment(F.col("v"), kind)
    rows = rows.select(ts.alias("ts"), (F.explode_outer(F.array_distinct("g")) if by else F.lit("all")).alias("group")).where("ts is not null").withColumn("group", F.col("group").cast("string"))
    if low:
        rows = rows.where(F.col("ts") >= F.lit(low).cast("timestamp"))
    if high:
        rows = rows.where(F.col("ts") <= F.lit(high + " 23:59:59.999" if len(high) == 10 else high).cast("timestamp"))
    out = rows.groupBy("group", F.date_trunc(bucket, "ts").alias("start")).agg(F.count(F.lit(1)).alias("count"))
    if fill:
        span = out.groupBy("group").agg(F.min("start").alias("a"), F.max("start").alias("b"))
        every = span.select("group", F.explode(F.sequence("a", "b", F.expr(STEPS[bucket]))).alias("start"))
        out = every.join(out.withColumnRenamed("group", "g2").withColumnRenamed("start", "s2"), F.col("group").eqNullSafe(F.col("g2")) & (F.col("start") == F.col("s2")), "left").select("group", "start", F.coalesce("count", F.lit(0)).alias("count"))
    out = out.select("group", bucket_key(F.col("start"), bucket).alias("bucket"), "start", (F.col("start") + F.expr(STEPS[bucket]) - F.expr("INTERVAL 0.001 SECOND")).alias("end"), "count")
    if cumulative:
        out = out.withColumn("running", F.sum("count").over(Window.partitionBy("group").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return out


def series_totals(line: DataFrame) -> DataFrame:
    """group, total, in the order of the series: total desc, group asc."""
    return line.groupBy("group").agg(F.sum("count").alias("total")).orderBy(F.desc("total"), "group")


def time_range(df: DataFrame, field: str) -> DataFrame:
    """first, last, valid, invalid, duration_ms."""
    ts = C.moment(F.col(field), C.field_type(df, field))
    return df.agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(ts).alias("valid"), F.count_if(ts.isNull()).alias("invalid"), (F.unix_millis(F.max(ts)) - F.unix_millis(F.min(ts))).alias("duration_ms"))


def deltas(df: DataFrame, order: str, fields: list[str], by: list[str] = (), first: str = "zero") -> DataFrame:
    """Change of each field since the row before in its partition; the first change is 0, or the value itself (`first` = value)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)  # snapshots: one row a day
    def one(f: str) -> Column:
        before = F.lag(f).over(w)
        return (F.col(f) - F.coalesce(before, F.lit(0)) if first == "value" else F.coalesce(F.col(f) - before, F.lit(0))).alias("delta_" + f)
    return df.select(*by, order, *fields, *[one(f) for f in fields])


def trend_data(df: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Wide to long: order, field, value."""
    return df.select(order, *[F.col(f).cast("double").alias(f) for f in fields]).unpivot([order], fields, "field", "value")


def trend(df: DataFrame, order: str, field: str, window: int = 7) -> DataFrame:
    """first, last, delta, percent (null where the first is 0), direction over the last `window` points."""
    last = df.orderBy(F.desc(order)).limit(window)
    a, b = F.min_by(field, order), F.max_by(field, order)
    out = last.agg(a.alias("first"), b.alias("last"), F.count(F.lit(1)).alias("points"))
    d = F.col("last") - F.col("first")
    return out.select("first", "last", "points", d.alias("delta"), F.when(F.col("first") != 0, F.round(100 * d / F.abs("first"), 6)).otherwise(F.when(d == 0, 0.0)).alias("percent"), F.when(d > 0, "up").when(d < 0, "down").otherwise("flat").alias("direction"))


def collapse_unchanged(df: DataFrame, order: str, fields: list[str], by: list[str] = (), keep: int = 672) -> DataFrame:
    """Of a run of equal snapshots the last one stays; then the newest `keep` of each partition."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    down = Window.partitionBy(*by).orderBy(F.desc(order)) if by else Window.orderBy(F.desc(order))
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.lead(f).over(w)) for f in fields]) & F.lead(order).over(w).isNotNull()
    return df.withColumn("_same", same).where(~F.col("_same")).drop("_same").withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= keep).drop("_r")


def rank_records(df: DataFrame, metric: str, tie: list[str], direction: str = "desc", limit: int = 10) -> DataFrame:
    """Top or bottom records by a metric whose missing values count as 0."""
    m = F.coalesce(F.col(metric), F.lit(0))
    return df.orderBy(m.desc() if direction == "desc" else m.asc(), *tie).limit(limit)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; a hash aggregate, so a hot key is pre-aggregated on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, "m.*")


def trailing_counts(df: DataFrame, ts: str, seconds: int, by: str) -> DataFrame:
    """Each event with the number of events of its partition in the trailing seconds, itself included.

    Time is cut into chunks of many such spans, so that tasks share a busy partition; the last span of a chunk is also
    laid before the next one. Events without a time count among themselves.
    """
    size = max(float(seconds), 1e-6) * 32
    t = F.col(ts).cast("timestamp").cast("double")
    chunk = F.floor(t / size)
    edge = t >= (chunk + 1) * size - float(seconds)
    rows = df.withColumn("_t", t).withColumn("_c", F.explode(F.when(edge, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy(by, "_c").orderBy("_t").rangeBetween(-seconds, 0)
    return rows.withColumn("trailing", F.count(F.lit(1)).over(w)).where(F.col("_c").eqNullSafe(F.floor(F.col("_t") / size))).drop("_t", "_c")


def stack(df: DataFrame, time: str, series: str, value: str, baseline: str = "zero") -> DataFrame:
    """time, series, value, low, high: cumulative offsets at each time; silhouette centres the stack."""
    w = Window.partitionBy(time).orderBy(series)
    v = F.col(value).cast("double")
    high = F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0))
    shift = F.sum(v).over(Window.partitionBy(time)) / 2 if baseline == "silhouette" else F.lit(0.0)
    return df.select(time, series, v.alias("value"), (high - v - shift).alias("low"), (high - shift).alias("high"))


def backoff(fails: Column, base: float, most: float) -> Column:
    """min(most, base * 2^(fails-1)) seconds; 0 without failures."""
    return F.when(fails <= 0, 0.0).otherwise(F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), fails - 1)))


def event_time(x: Column) -> Column:
    """Numbers below 1e11 are seconds, others milliseconds."""
    return F.when(F.abs(x) < 1e11, F.timestamp_seconds(x)).otherwise(F.timestamp_millis(x.cast("bigint")))


def schedule(df: DataFrame, score: Column, eligible: Column, budget: int, tie: list[str]) -> DataFrame:
    """The eligible sources of the highest score, at most the budget."""
    return df.where(C.two_valued(eligible)).withColumn("score", score).orderBy(F.desc("score"), *tie).limit(budget)


def rolling_health(df: DataFrame, by: str, ts: str, ok: Column, latency: Column, since: str) -> DataFrame:
    """by, samples, uptime, error_rate, mean, p50 and p95 latency and state over the samples since a time."""
    rows = df.where(F.col(ts) >= F.lit(since).cast("timestamp"))
    up = F.avg(ok.cast("double"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.round(up, 6).alias("uptime"), F.round(1 - up, 6).alias("error_rate"), F.round(F.avg(latency), 6).alias("latency_mean"),
        F.when(up >= 0.75, "healthy").when(up >= 0.4, "degraded").otherwise("unhealthy").alias("state"))
    cuts = quantiles(rows.select(by, latency.alias("_latency")), [by], "_latency", (0.5, 0.95))
    return with_quantiles(out, cuts, [by]).select(by, "samples", "uptime", "error_rate", "latency_mean", F.get("cuts", F.lit(0)).alias("latency_p50"), F.get("cuts", F.lit(1)).alias("latency_p95"), "state")
