"""JSON predicates compiled to one column expression, and the filter pipeline around them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import coerce as C


class FilterError(ValueError):
    """The predicate cannot be read."""


def java_regex(spec: Any) -> str:
    """Pattern of '/pat/flags', {'pattern', 'flags'} or a bare string (then without case); g is dropped, y refused."""
    if isinstance(spec, dict):
        pattern, flags = str(spec.get("pattern", "")), str(spec.get("flags", ""))
    elif isinstance(spec, str) and (m := re.fullmatch(r"/(.*)/([a-z]*)", spec, re.S)):
        pattern, flags = m.groups()
    else:
        pattern, flags = str(spec), "i"
    if "y" in flags:
        raise FilterError("sticky patterns are not supported")
    used = "".join(f for f in "ims" if f in flags)
    return (f"(?{used})" if used else "") + pattern


def wildcard_regex(pattern: str) -> str:
    """* is any run, ? one character; anchored, without case."""
    return "(?is)^" + "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"


def _eq(c: Column, kind: T.DataType, v: Any) -> Column:
    if v is None:
        return c.isNull()
    n = C.literal_number(v)
    same_text = (C.folded(c) == str(v).strip().lower()) & c.isNotNull()
    if isinstance(v, bool):
        same_text = F.when(C.folded(c).isin("true", "false"), C.folded(c) == str(v).lower()).otherwise(F.lit(False))
    if n is None:
        return C.two_valued(same_text)
    own = C.number(c, kind)
    return C.two_valued(F.when(c.isNotNull() & own.isNotNull(), own == F.lit(n)).otherwise(same_text))


def _compare(c: Column, kind: T.DataType, v: Any, op: str) -> Column:
    test = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[op]
    n, moment = C.literal_number(v), C.literal_moment(v)
    branches = []
    if n is not None and not isinstance(kind, C.TIMES):
        own = F.when(c.isNull(), 0.0).otherwise(C.number(c, kind))  # an explicit null counts as 0
        branches.append(F.when(own.isNotNull(), test(own, F.lit(n))))
    if moment is not None:
        own = C.moment(c, kind)
        branches.append(F.when(own.isNotNull(), test(own, F.lit(moment).cast("timestamp"))))
    branches.append(F.when(c.isNotNull(), test(C.natural_key(c), F.lit(C.literal_natural(v)))))
    return C.two_valued(F.coalesce(*branches))


def _one(c: Column, kind: T.DataType, op: str, v: Any) -> Column:
    if op in ("$gt", "$gte", "$lt", "$lte"):
        return _compare(c, kind, v, op)
    if op == "$eq":
        return _eq(c, kind, v)
    if op == "$ne":
        return ~_eq(c, kind, v)
    listed = v if isinstance(v, (list, tuple)) else [v]
    if op in ("$in", "$nin"):
        some = F.lit(False)
        for x in listed:
            some = some | _eq(c, kind, x)
        return some if op == "$in" else ~some
    needle = str(v).strip().lower()
    if op == "$contains":
        return C.folded(c).contains(needle)
    if op == "$startsWith":
        return C.folded(c).startswith(needle)
    if op == "$endsWith":
        return C.folded(c).endswith(needle)
    if op == "$regex":
        return C.two_valued(C.text(c).rlike(java_regex(v)))
    if op == "$wildcard":
        return C.two_valued(C.text(c).rlike(wildcard_regex(str(v).strip())))
    if op == "$between":
        return _compare(c, kind, listed[0], "$gte") & _compare(c, kind, listed[1], "$lte") if len(listed) >= 2 else F.lit(False)
    if op == "$size":
        return C.two_valued(F.length(c.cast("string")) == int(v))
    if op == "$type":
        name = "boolean" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, C.NUMERIC) else "object" if isinstance(kind, (T.StructType, T.MapType)) else "string"
        return c.isNull() if v == "null" else c.isNotNull() & F.lit(name == v)
    raise FilterError(f"Unsupported filter operator: {op}")


def _field(df: DataFrame, path: str, op: str, v: Any) -> Column:
    kind = C.field_type(df, path)
    if isinstance(kind, T.NullType):
        return F.lit(op in ("$exists",) and v is False or op in ("$none", "$all") and not v)
    many, inner = isinstance(kind, T.ArrayType), C.element_type(kind)
    vals = C.values(df, path)
    if op == "$exists":
        has = F.size(F.filter(vals, lambda x: x.isNotNull())) > 0
        return has if v is not False else ~has
    if op == "$all":
        out = F.lit(True)
        for x in v:
            out = out & _field(df, path, "$eq", x)
        return out
    if op == "$none":
        return ~_field(df, path, "$in", v)
    return F.exists(vals, lambda c: _one(c, inner, op, v)) if many else _one(F.col(path), inner, op, v)


def _condition(df: DataFrame, path: str, spec: Any) -> Column:
    if isinstance(spec, (list, tuple)):
        return _field(df, path, "$in", list(spec))
    if isinstance(spec, dict):
        if any(k.startswith("$") for k in spec):
            out = F.lit(True)
            for op, v in spec.items():  # each operator may be met by another element
                out = out & (~_condition(df, path, v) if op == "$not" else _field(df, path, op, v))
            return out
        if set(spec) & {"min", "max"}:
            out = F.lit(True)
            for key, op in (("min", "$gte"), ("max", "$lte")):
                if spec.get(key) is not None:
                    out = out & _field(df, path, op, spec[key])
            return out
        raise FilterError(f"Unsupported condition on {path}")
    return _field(df, path, "$contains" if isinstance(spec, str) else "$eq", spec)


def compile_filter(df: DataFrame, spec: Any, strict: bool = False) -> Column:
    """Boolean column, never null, of a predicate over df's columns.

    A list is a conjunction, {} matches all. strict keeps the rule that the first of $and, $or, $not in an object
    hides the conditions beside it and that $exists, $all and $none are refused; otherwise all count.
    """
    if spec is None:
        return F.lit(True)
    if isinstance(spec, (list, tuple)):
        out = F.lit(True)
        for s in spec:
            out = out & compile_filter(df, s, strict)
        return out
    if not isinstance(spec, dict):
        raise FilterError("a filter is an object or a list of objects")
    out, logical = F.lit(True), [k for k in ("$and", "$or", "$not") if k in spec]
    for key in logical[:1] if strict else logical:
        if key == "$and":
            out = out & compile_filter(df, list(spec[key]), strict)
        elif key == "$or":
            some = F.lit(False)
            for s in spec[key]:
                some = some | compile_filter(df, s, strict)
            out = out & some
        else:
            out = out & ~compile_filter(df, spec[key], strict)
    if strict and logical:
        return out
    for path, cond in spec.items():
        if path in ("$and", "$or", "$not"):
            continue
        if strict and isinstance(cond, dict) and set(cond) & {"$exists", "$all", "$none"}:
            raise FilterError("Unsupported filter operator")
        out = out & _condition(df, path, cond)
    return out


def page_bounds(limit: int, page: int = 1, offset: int = 0, most: int = 10_000) -> tuple[int, int]:
    """(offset, limit): an offset above 0 goes before the page."""
    limit = max(1, min(most, limit))
    return (offset if offset > 0 else (max(1, page) - 1) * limit), limit


@dataclass
class Page:
    """Lazy parts of an answer: the page, all matches, and facets by field."""

    rows: DataFrame
    matches: DataFrame
    facets: dict[str, DataFrame]
    limit: int

    def total(self) -> int:
        return self.matches.count()

    def pages(self) -> int:
        return math.ceil(self.total() / self.limit)


def facet(df: DataFrame, path: str, limit: int = 100, per_record: bool = True) -> DataFrame:
    """value, count: in how many records each value occurs (per_record), or how often it occurs; count desc, value."""
    vals = C.values(df, path, "drop")
    if per_record:
        vals = F.array_distinct(vals)
    rows = df.select(F.explode(vals).alias("value")).select(F.col("value").cast("string").alias("value")).where("value <> ''")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def project(df: DataFrame, fields: list[str], collapse: bool = False) -> DataFrame:
    """The named paths, each column named by its path; collapse turns one-element arrays into their element as text."""
    def one(f: str) -> Column:
        if not collapse or not isinstance(C.field_type(df, f), T.ArrayType):
            return (F.col(f) if f.split(".")[0] in df.columns else F.lit(None).cast("string")).alias(f)
        v = C.values(df, f)
        return F.when(F.size(v) == 1, F.get(v, F.lit(0)).cast("string")).when(F.size(v) > 1, F.to_json(v)).alias(f)
    return df.select(*[one(f) for f in fields])


def filter_records(df: DataFrame, spec: Any = None, sort: str | None = None, order: str = "asc", limit: int = 100, offset: int = 0, page: int = 1, everything: bool = False, select: list[str] | None = None, facets: list[str] = (), facet_scope: str = "matches", tie: list[str] = (), policy: str = "worker") -> Page:
    """Filter, stable sort, page, project, facet. tie names the columns that stand for the input order."""
    hits = df.where(compile_filter(df, spec))
    start, size = page_bounds(limit, page, offset)
    rows = hits
    if sort:
        rows = rows.orderBy(C.ordering(F.col(sort), order == "desc", policy), *tie)
    elif tie:
        rows = rows.orderBy(*tie)
    if not everything:
        rows = rows.offset(start).limit(size) if start else rows.limit(size)
    scope = rows if facet_scope == "page" else hits
    return Page(project(rows, select) if select else rows, hits, {f: facet(scope, f) for f in facets}, size)
