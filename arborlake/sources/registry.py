"""Plug-in sources: a paged data source with filters pushed into the request, a registry, cursors and manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

NAME = re.compile(r"^[a-z][a-z0-9_]{1,63}$")


class PagePartition(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedSource(DataSource):
    """Offset-paged records of a `fetch(filters, offset, limit) -> list of dicts` plug-in.

    Options: fetch (module:function), schema (DDL), total, page, filters (JSON). Pages are partitions, so they are
    read in parallel; equality filters go into the request where spark.sql.python.filterPushdown.enabled is true.
    """

    @classmethod
    def name(cls) -> str:
        return "arborlake_paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.columns = [f.name for f in schema.fields]
        self.target, self.total, self.page = options["fetch"], int(options.get("total", 0)), int(options.get("page", 500))
        self.filters: dict[str, Any] = json.loads(options.get("filters", "{}"))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo):
                self.filters[".".join(f.attribute)] = f.value
            yield f  # Spark checks again, as a service may ignore a parameter

    def partitions(self):
        return [PagePartition(o, self.page) for o in range(0, max(1, self.total), self.page)]

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        module, _, name = self.target.partition(":")
        fetch: Callable = getattr(__import__(module, fromlist=[name]), name)
        for row in fetch(self.filters, partition.offset, partition.limit):
            yield tuple(None if row.get(c) is None else str(row[c]) for c in self.columns)


def demo(filters: dict[str, Any], offset: int, limit: int) -> list[dict[str, Any]]:
    """A source without a service behind it: 25 records of two kinds."""
    rows = [{"id": i, "kind": "ab"[i % 2]} for i in range(25)]
    return [r for r in rows[offset : offset + limit] if all(str(r[k]) == str(v) for k, v in filters.items())]


class Registry:
    """Named sources with their definitions; partitions them into eligible and skipped with a reason."""

    def __init__(self) -> None:
        self.sources: dict[str, dict[str, Any]] = {}

    def add(self, name: str, definition: dict[str, Any]) -> None:
        problems = definition_issues(name, definition)
        if problems:
            raise ValueError(", ".join(problems))
        self.sources[name] = definition

    def eligible(self, only: list[str] = (), present: set[str] = frozenset()) -> tuple[list[str], dict[str, str]]:
        good, skipped = [], {}
        for n, d in sorted(self.sources.items()):
            missing = [e for e in d.get("requires", []) if e not in present]
            if only and n not in only:
                skipped[n] = "not requested"
            elif not d.get("enabled", True):
                skipped[n] = "disabled"
            elif missing:
                skipped[n] = "missing " + ", ".join(missing)
            else:
                good.append(n)
        return good, skipped


def definition_issues(name: str, definition: Any) -> list[str]:
    """Codes of what is wrong with a source definition."""
    if not isinstance(definition, dict):
        return ["provider_definition_not_object"]
    out = []
    if not NAME.match(name or ""):
        out.append("provider_name_missing")
    if not definition.get("module"):
        out.append("provider_module_missing")
    if not isinstance(definition.get("enabled", True), bool):
        out.append("provider_enabled_not_boolean")
    if not isinstance(definition.get("batch_size", 500), int) or definition.get("batch_size", 500) < 1:
        out.append("provider_batch_size_invalid")
    if definition.get("endpoint") and not re.match(r"^https?://", definition["endpoint"]):
        out.append("provider_endpoint_not_http")
    return out


def cursor_issues(cursor: Any, most: int = 65_536) -> list[str]:
    """Codes of what is wrong with a saved cursor."""
    if cursor is not None and not isinstance(cursor, (str, int, float, bool, dict, list)):
        return ["cursor_unsupported_type"]
    try:
        text = json.dumps(cursor)
    except (TypeError, ValueError):
        return ["cursor_not_serializable"]
    return ["cursor_too_long"] if len(text) > most else []


def save_state(old: DataFrame, source: str, cursor: str | None, error: str | None, at: str) -> DataFrame:
    """Source states after one run: a success moves the cursor and clears the error, a failure keeps the cursor and counts."""
    spark: SparkSession = old.sparkSession
    row = spark.createDataFrame([(source, cursor, error, at)], "source string, cursor string, error string, at string")
    was = old.where(F.col("source") == source).select("source", F.col("cursor").alias("c0"), F.col("failures").alias("f0"))
    j = row.join(was, "source", "left")
    new = j.select("source", F.when(F.col("error").isNull(), F.col("cursor")).otherwise(F.col("c0")).alias("cursor"), F.when(F.col("error").isNull(), 0).otherwise(F.coalesce("f0", F.lit(0)) + 1).cast("int").alias("failures"), F.col("error").alias("last_error"), F.col("at").alias("updated_at"))
    return old.where(F.col("source") != source).unionByName(new)


class Manifest:
    """Dotted-path document of an archive; the counters are recomputed from the tables, not counted up."""

    def __init__(self, data: dict[str, Any] | None = None):
        self.data = data or {}

    def get(self, path: str, default: Any = None) -> Any:
        x: Any = self.data
        for p in path.split("."):
            if not isinstance(x, dict) or p not in x:
                return default
            x = x[p]
        return x

    def set(self, path: str, value: Any) -> None:
        *head, last = path.split(".")
        x = self.data
        for p in head:
            x = x.setdefault(p, {})
        x[last] = value

    def delete(self, path: str) -> bool:
        *head, last = path.split(".")
        x = self.get(".".join(head)) if head else self.data
        return isinstance(x, dict) and x.pop(last, None) is not None

    def increment(self, path: str, by: int = 1) -> int:
        self.set(path, int(self.get(path, 0)) + by)
        return self.get(path)

    def sync(self, taxa: DataFrame) -> None:
        r = taxa.agg(F.count_distinct("speciedex_id").alias("records"), F.count_distinct("volume_file").alias("volumes")).first()
        self.data.setdefault("counters", {}).update(records=r.records, volumes=r.volumes)
