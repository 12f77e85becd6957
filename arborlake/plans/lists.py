"""List services: one parametrised listing over any table, and the named filters of provider, archive and taxon lists."""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions import coerce as C
from arborlake.functions import taxonomy as X
from arborlake.plans.filterlang import page_bounds
from arborlake.session import checkpoint


@dataclass(frozen=True)
class ListSpec:
    """What a list may be asked for: fields of equality, flags, number ranges, a date range, text fields and sort keys."""

    text: list[str]
    equal: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    ranges: list[str] = field(default_factory=list)
    date: str | None = None
    sorts: list[str] = field(default_factory=list)
    tie: list[str] = field(default_factory=list)


class ListError(ValueError):
    """A parameter is not allowed or has a wrong value."""


def query_list(df: DataFrame, spec: ListSpec, **params: Any) -> DataFrame:
    """Listing by q, equality fields, flags, min_/max_ ranges, from/to dates, sort, direction, limit and offset; unknown parameters are refused."""
    cond = F.lit(True)
    sort, direction = params.pop("sort", None), params.pop("direction", "asc")
    limit, offset = int(params.pop("limit", 50)), int(params.pop("offset", 0))
    if direction not in ("asc", "desc") or (sort and sort not in spec.sorts):
        raise ListError("sort or direction is not allowed")
    for name, v in params.items():
        if v is None:
            continue
        if name == "q":
            some = F.lit(False)
            for f in spec.text:
                some = some | C.folded(F.col(f)).contains(str(v).strip().lower())
            cond = cond & some
        elif name in spec.equal:
            cond = cond & C.two_valued(C.folded(F.col(name)) == str(v).strip().lower())
        elif name in spec.flags:
            if not isinstance(v, bool):
                raise ListError(f"{name} must be true or false")
            cond = cond & (F.coalesce(F.col(name).cast("boolean"), F.lit(False)) == F.lit(v))
        elif name[:4] in ("min_", "max_") and name[4:] in spec.ranges:
            x = F.col(name[4:]).cast("double")
            cond = cond & C.two_valued(x >= float(v) if name[:3] == "min" else x <= float(v))
        elif name in ("date_from", "date_to") and spec.date:
            ts = C.moment(F.col(spec.date), C.field_type(df, spec.date))
            edge = f"{v} 23:59:59.999" if name == "date_to" and len(str(v)) == 10 else str(v)
            cond = cond & C.two_valued(ts >= F.lit(edge).cast("timestamp") if name == "date_from" else ts <= F.lit(edge).cast("timestamp"))
        else:
            raise ListError(f"unknown parameter {name}")
    rows = df.where(cond)
    keys = ([C.ordering(F.col(sort), direction == "desc")] if sort else []) + [F.col(t) for t in spec.tie]
    rows = rows.orderBy(*keys) if keys else rows
    start, size = page_bounds(limit, 1, offset, 1000)
    return rows.offset(start).limit(size) if start else rows.limit(size)


def flatten_columns(df: DataFrame) -> DataFrame:
    """Nested objects as columns named by their dotted path; arrays stay."""
    def walk(schema, prefix: str) -> list[Column]:
        out = []
        for f in schema.fields:
            path = f"{prefix}{f.name}"
            quoted = ".".join(f"`{p}`" for p in path.split("."))
            out += walk(f.dataType, path + ".") if f.dataType.typeName() == "struct" else [F.col(quoted).alias(path)]
        return out
    return df.select(*walk(df.schema, ""))


def flatten_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, value of the scalar leaves of a JSON text of any depth, arrays as [i]: by variant explosion.

    Each round takes one level apart and writes what is still nested, until nothing is. Empty objects and arrays have
    no leaves; text that is null or no JSON has none.
    """
    spark, parts, tag = df.sparkSession, [], uuid.uuid4().hex
    now, path = df.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(text).alias("v")), "coalesce(x.key, concat('[', x.pos, ']'))"
    for level in itertools.count():
        now.createOrReplaceTempView(f"_flatten_{tag}_{level}")
        now = checkpoint(spark.sql(f"SELECT `{key}`, path || {path} AS path, x.value AS v FROM _flatten_{tag}_{level}, LATERAL variant_explode(v) x"))
        spark.catalog.dropTempView(f"_flatten_{tag}_{level}")
        path = "CASE WHEN x.key IS NULL THEN concat('[', x.pos, ']') ELSE concat('.', x.key) END"
        kind = F.expr("schema_of_variant(v)")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        parts.append(now.where(~nested).select(key, "path", F.col("v").cast("string").alias("value")))
        now = now.where(nested)
        if now.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Named filters: columns over the fields they read.
def slow(latency: Column, threshold: float = 1000) -> Column:
    return C.two_valued(latency >= threshold)


def low_confidence(confidence: Column, threshold: float = 0.5) -> Column:
    """At most the threshold, or missing; percentages are divided by 100."""
    c = F.when(confidence > 1, confidence / 100).otherwise(confidence)
    return c.isNull() | (c <= threshold)


def stale(ts: Column, now: str, hours: float) -> Column:
    """Older than so many hours, or without a time."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts)) / 3.6e9
    return F.coalesce(age > hours, F.lit(True))


def between(ts: Column, low: str, high: str) -> Column:
    return C.two_valued((ts >= F.lit(low).cast("timestamp")) & (ts <= F.lit(high).cast("timestamp")))


def by_rank(rank: str, name: str) -> Column:
    """Records whose column of a higher rank has the name."""
    return C.two_valued(X.key(F.col({"class": "class_name", "order": "order_name"}.get(rank, rank))) == name.strip().lower())


def conflict_values(df: DataFrame, group: list[str], value: str, provider: str, confidence: str) -> DataFrame:
    """group, value, providers, records, mean confidence: the rival values of each conflict."""
    return df.groupBy(*group, value).agg(F.array_join(F.array_sort(F.collect_set(provider)), ",").alias("providers"), F.count(F.lit(1)).alias("records"), F.round(F.avg(confidence), 6).alias("confidence"))


def age_hours(ts: Column, now: str) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(ts)) / 3.6e9)


def scan_jobs(df: DataFrame, key: list[str], order: str, name: str, rank: str) -> DataFrame:
    """Per record: duplicate (not the first of its key by order) and conflicting (its name has several ranks)."""
    first = df.groupBy(*key).agg(F.min(order).alias("_first"))
    ranks = df.groupBy(F.lower(name).alias("_name")).agg(F.count_distinct(rank).alias("_ranks"))
    j = df.join(first, key).join(ranks, F.lower(name) == F.col("_name"), "left")
    return j.select(*df.columns, (F.col(order) != F.col("_first")).alias("duplicate"), (F.coalesce("_ranks", F.lit(0)) > 1).alias("conflicting"))
