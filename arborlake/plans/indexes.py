"""Posting-list searches, their scores, and other lookups over indexed records."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.stats import quantiles
from arborlake.plans.filterlang import page_bounds
from arborlake.plans.searchlang import postings

SPLIT = "[^a-z0-9._:-]+"


def tokens_of(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(SPLIT, text.lower()) if t))


def index_score(df: DataFrame, query: str, fields: list[str], weights: dict[str, int] | None = None, fuzzy: bool = True) -> Column:
    """Sum over fields: equal 20 and no more; else beginning 12 and within 8, and for each query token 3 if the value has it or 1 if it has one near to it; times the weight."""
    want, tokens, out = query.strip().lower(), tokens_of(query), F.lit(0)
    for f in fields:
        v = F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))))
        have = F.array_distinct(F.split(v, SPLIT))
        part = F.when(v.startswith(want), 12).otherwise(0) + F.when(v.contains(want), 8).otherwise(0)
        for t in tokens:
            near = F.size(F.filter(have, _near(t))) > 0 if fuzzy and len(t) >= 4 else F.lit(False)
            part = part + F.when(F.array_contains(have, t), 3).when(near, 1).otherwise(0)
        out = out + (weights or {}).get(f, 1) * F.when(v == "", 0).when(v == want, 20).otherwise(part)
    return out


def _near(token: str):
    most = 1 if len(token) <= 6 else 2
    return lambda h: F.levenshtein(h, F.lit(token), most) >= 0


def index_search(df: DataFrame, key: str, query: str, fields: list[str], weights: dict[str, int] | None = None, fuzzy: bool = True, limit: int = 50, offset: int = 0, page: int = 1) -> DataFrame:
    """Records whose postings hold all known query tokens (all records if none is known), scored; those without a score are dropped.

    The postings are reduced to the few query tokens before anything is shuffled.
    """
    tokens = tokens_of(query)
    hit = postings(df, key, fields).where(F.col("token").isin(tokens)).select(key, "token").distinct()
    known = hit.agg(F.count_distinct("token").alias("known"))
    per = df.select(key).distinct().join(hit.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").crossJoin(F.broadcast(known))
    keys = per.where(F.coalesce("n", F.lit(0)) == F.col("known")).select(key)
    rows = df.join(keys, key, "left_semi").withColumn("score", index_score(df, query, fields, weights, fuzzy).cast("bigint")).where("score > 0")
    start, size = page_bounds(limit, page, offset, 1000)
    rows = rows.orderBy(F.desc("score"), key)
    return rows.offset(start).limit(size) if start else rows.limit(size)


def union_search(df: DataFrame, key: str, query: str, fields: list[str], weights: dict[str, float] | None = None, prefix: bool = True) -> DataFrame:
    """key, score over the union of the terms' candidates: an equal value weight + 40, a token the weight, a beginning (of at most 24 letters) max(1, 0.65 weight); weight 10 unless given."""
    score = F.lit(0.0)
    for f in fields:
        w = float((weights or {}).get(f, 10))
        v = F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))))
        have = F.array_distinct(F.split(v, SPLIT))
        for t in tokens_of(query):
            begins = F.size(F.filter(have, _begins(t))) > 0 if prefix and len(t) <= 24 else F.lit(False)
            score = score + F.when(v == t, w + 40).otherwise(0.0) + F.when(F.array_contains(have, t), w).when(begins, max(1.0, 0.65 * w)).otherwise(0.0)
    return df.select(key, score.alias("score")).where("score > 0")


def _begins(token: str):
    return lambda h: h.startswith(token)


def density_modes(hist: DataFrame, mode: str = "count") -> DataFrame:
    """Histogram bins as count, probability, percent or density, with the cumulative share."""
    total = hist.agg(F.sum("weight").alias("total"))
    w = F.col("weight")
    value = {"count": w, "probability": F.try_divide(w, F.col("total")), "percent": 100 * F.try_divide(w, F.col("total")), "density": F.try_divide(w, F.col("total") * (F.col("high") - F.col("low")))}[mode]
    out = hist.crossJoin(F.broadcast(total)).withColumn("value", value)
    return out.withColumn("cdf", F.sum(F.try_divide(F.col("weight"), F.col("total"))).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).drop("total")


def slider(df: DataFrame, ts: str, buckets: int = 60, weight: str | None = None) -> DataFrame:
    """bucket, value, share of the greatest bucket, over equal parts of the time range."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(t.alias("t"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).where("t is not null")
    span = rows.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    at = F.when(F.col("a") == F.col("b"), 0).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("a")) / (F.col("b") - F.col("a")) * buckets))).cast("int")
    out = rows.crossJoin(F.broadcast(span)).groupBy(at.alias("bucket")).agg(F.sum("w").alias("value"))
    top = out.agg(F.max("value").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("bucket", "value", F.round(F.col("value") / F.col("top"), 6).alias("share"))


def heat_scale(df: DataFrame, value: str, mode: str = "linear", buckets: int = 5) -> DataFrame:
    """`scaled` by linear or logarithmic share of the range, or the number of quantile bounds below the value."""
    v = F.col(value).cast("double")
    if mode == "quantile":
        cuts = quantiles(df.select(v.alias("_v")), [], "_v", tuple(i / buckets for i in range(1, buckets)))
        return df.crossJoin(F.broadcast(cuts)).withColumn("scaled", F.size(F.filter("cuts", lambda c: c < v)).cast("double")).drop("cuts")
    x = F.log1p(F.greatest(v, F.lit(0.0))) if mode == "log" else v
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return df.crossJoin(F.broadcast(span)).withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(v.isNotNull(), 0.0))).drop("_lo", "_hi")


def within_window(ts: Column, at: str, hours: float) -> Column:
    """Half the window around a time; records without a time always stay."""
    half = int(hours * 3.6e9 / 2)
    return ts.isNull() | (F.abs(F.unix_micros(ts) - F.unix_micros(F.lit(at).cast("timestamp"))) <= half)


def evict(df: DataFrame, size: str, used: str, budget: int, tie: list[str]) -> DataFrame:
    """Cache entries that no longer fit when the most recently used come first; entries are grouped by hour of use before the running sum."""
    hour = F.date_trunc("hour", F.col(used).cast("timestamp"))
    per = df.groupBy(hour.alias("_h")).agg(F.sum(size).alias("_s"))
    before = per.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy(F.desc("_h")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = F.sum(size).over(Window.partitionBy("_h").orderBy(F.desc(used), *tie).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_h", hour).join(before, "_h").withColumn("_sum", F.col("_before") + inside).where(F.col("_sum") > budget).drop("_h", "_before", "_sum")


def freshness(df: DataFrame, by: str, ts: str, now: str, warn_hours: float = 48) -> DataFrame:
    """by, newest, age in hours and status: warning when older than the limit, critical without a time."""
    newest = df.groupBy(by).agg(F.max(F.col(ts).cast("timestamp")).alias("newest"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("newest")) / 3.6e9
    return newest.select(by, "newest", F.round(F.greatest(F.lit(0.0), age), 6).alias("age_hours"), F.when(F.col("newest").isNull(), "critical").when(age > warn_hours, "warning").otherwise("ok").alias("status"))


def verify_index(taxa: DataFrame, refs: dict[str, DataFrame], key: str = "speciedex_id") -> DataFrame:
    """check, count: orphan rows of each table, rows without a key, and repeated keys."""
    ids = taxa.select(key).distinct()
    parts = [t.where(F.col(key).isNotNull()).join(ids, key, "left_anti").agg(F.lit(f"orphan_{n}").alias("check"), F.count(F.lit(1)).alias("count")) for n, t in refs.items()]
    parts.append(taxa.agg(F.lit("missing_key").alias("check"), F.count_if(F.trim(F.coalesce(F.col(key), F.lit(""))) == "").alias("count")))
    parts.append(taxa.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("repeated_key").alias("check"), F.count(F.lit(1)).alias("count")))
    return reduce(DataFrame.unionByName, parts)
