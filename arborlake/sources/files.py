"""File sources: JSON lines and documents, delimited text, star-schema archives, and declarative mapping to records."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
import zipfile
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.plans.filterlang import java_regex


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a bad line, otherwise bad lines are skipped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def json_document(spark: SparkSession, path: str, records: str | None = None, record_key: str | None = None) -> DataFrame:
    """Whole-file JSON: the array at a dotted path exploded; an object of records gives its keys as record_key."""
    df = spark.read.option("multiLine", True).json(path)
    if not records:
        return df
    kind: Any = df.schema
    for part in records.split("."):
        kind = kind[part].dataType
    if isinstance(kind, T.ArrayType):
        return df.select(F.explode(records).alias("r")).select("r.*" if isinstance(kind.elementType, T.StructType) else "r")
    cells = [F.struct(F.lit(f.name).alias(record_key or "key"), F.col(f"{records}.{f.name}").alias("r")) for f in kind.fields]
    return df.select(F.explode(F.array(*cells)).alias("x")).select(f"x.{record_key or 'key'}", "x.r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """index (from 1) and value of the lines of a text; lines keep their order by a file read in one piece."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "value")).select((F.col("i") + 1).alias("index"), "value")


def header_names(cells: list[str]) -> list[str]:
    """Blank headers become columnN, repeated ones get _2, _3."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = (c or "").strip() or f"column{i + 1}"
        base, n = name, 2
        while name in out:
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Quoted delimited text with a header: rows that are all blank are dropped, missing cells are ''."""
    raw = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE")
    first = raw.csv(path).limit(1).first()
    names = header_names([c for c in first]) if first else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = raw.option("header", True).option("enforceSchema", True).schema(schema).csv(path).fillna("")
    some = F.lit(False)
    for n in names:
        some = some | (F.trim(F.col(f"`{n}`")) != "")
    return df.where(some)


def volumes(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of all volumes of an archive with the name of their file."""
    return spark.read.schema(schema).json(path).withColumn("_volume_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


# Well-known names of core files of a star-schema archive.
CORE_FILES = ["taxon.txt", "taxon.tsv", "taxon.csv", "taxa.txt", "taxa.tsv", "taxa.csv", "core.txt", "core.csv"]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _last(term: str) -> str:
    return re.split(r"[/#]", term.rstrip("/"))[-1]


def archive_meta(folder: str) -> list[dict[str, Any]]:
    """Tables of an archive: role, files, separator, quote, header lines, columns by index, defaults and the id column."""
    meta = os.path.join(folder, "meta.xml")
    if not os.path.exists(meta):
        name = next((f for f in CORE_FILES if os.path.exists(os.path.join(folder, f))), None)
        if name is None:
            raise FileNotFoundError("no meta.xml and no known core file")
        return [{"role": "core", "name": "core", "files": [name], "sep": "," if name.endswith("csv") else "\t", "quote": '"', "skip": 1, "columns": None, "defaults": {}, "id": None}]
    out = []
    for t in ET.parse(meta).getroot():
        if _local(t.tag) not in ("core", "extension"):
            continue
        fields = [x for x in t if _local(x.tag) == "field"]
        ident = next((int(x.get("index", 0)) for x in t if _local(x.tag) in ("id", "coreid")), 0)
        out.append({
            "role": _local(t.tag), "name": _last(t.get("rowType", _local(t.tag))), "files": [loc.text.strip() for x in t if _local(x.tag) == "files" for loc in x if loc.text],
            "sep": t.get("fieldsTerminatedBy", ",").encode().decode("unicode_escape"), "quote": t.get("fieldsEnclosedBy", '"'), "skip": int(t.get("ignoreHeaderLines", 0)),
            "columns": {int(f.get("index")): _last(f.get("term")) for f in fields if f.get("index") is not None}, "defaults": {_last(f.get("term")): f.get("default") for f in fields if f.get("default") is not None}, "id": ident,
        })
    return out


def archive_table(spark: SparkSession, folder: str, spec: dict[str, Any]) -> DataFrame:
    """One table with _id and _malformed: short rows are flagged and kept, blanks take the default."""
    paths = [os.path.join(folder, f) for f in spec["files"]]
    reader = spark.read.option("sep", spec["sep"]).option("mode", "PERMISSIVE")
    reader = reader.option("quote", spec["quote"]) if spec["quote"] else reader.option("quote", "")
    if spec["columns"] is None:
        df = reader.option("header", True).csv(paths)
        return df.withColumn("_id", F.col(df.columns[0])).withColumn("_malformed", F.lit(False))
    width = max([*spec["columns"], spec["id"]]) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)] + [T.StructField("_bad", T.StringType())])
    df = reader.option("header", spec["skip"] > 0).option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").schema(schema).csv(paths)
    def cell(i: int, term: str) -> Column:
        v = F.nullif(F.trim(F.col(f"c{i}")), F.lit(""))
        return F.coalesce(v, F.lit(spec["defaults"].get(term))).alias(term)
    cols = [cell(i, t) for i, t in spec["columns"].items()] + [F.lit(d).alias(t) for t, d in spec["defaults"].items() if t not in spec["columns"].values()]
    return df.select(F.col(f"c{spec['id']}").alias("_id"), F.col("_bad").isNotNull().alias("_malformed"), *cols)


def star_archive(spark: SparkSession, folder: str, cap: int | None = 1000, allow: list[str] | None = None) -> DataFrame:
    """Core rows with a map of extension name to an array of its rows as JSON (the first `cap` of a core row and extension, as the format's reader limits them)."""
    tables = archive_meta(folder)
    core = archive_table(spark, folder, next(t for t in tables if t["role"] == "core"))
    rows = None
    for t in tables:
        if t["role"] != "extension" or (allow and t["name"] not in allow):
            continue
        e = archive_table(spark, folder, t)
        part = e.select("_id", F.lit(t["name"]).alias("extension"), F.to_json(F.struct(*[c for c in e.columns if not c.startswith("_")])).alias("row"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return core.withColumn("extensions", F.create_map().cast("map<string,array<string>>"))
    if cap:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "extension").orderBy("row"))).where(F.col("_n") <= cap).drop("_n")
    by = rows.groupBy("_id", "extension").agg(F.array_sort(F.collect_list("row")).alias("rows")).groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("extension", "rows"))).alias("extensions"))
    return core.join(by, "_id", "left")


def unpack(path: str, folder: str) -> str:
    """Unpack a zipped archive into a folder that all executors can read."""
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            if os.path.isabs(n) or ".." in n.split("/"):
                raise ValueError(f"unsafe member {n}")
        z.extractall(folder)
    return folder


def path_column(path: str) -> Column:
    """Value at a path of a JSON text column `_raw`: dots, [n] and [*]."""
    return F.get_json_object("_raw", "$." + path)


TRANSFORMS = {
    "strip": lambda c, a: F.trim(c), "trim": lambda c, a: F.trim(c), "lower": lambda c, a: F.lower(c), "casefold": lambda c, a: F.lower(c), "upper": lambda c, a: F.upper(c), "title": lambda c, a: F.initcap(c),
    "int": lambda c, a: c.try_cast("bigint").cast("string"), "float": lambda c, a: c.try_cast("double").cast("string"), "bool": lambda c, a: F.lower(F.trim(c)).isin("1", "true", "yes", "on").cast("string"),
    "prefix": lambda c, a: F.when(c != "", F.concat(F.lit(a), c)).otherwise(c), "suffix": lambda c, a: F.when(c != "", F.concat(c, F.lit(a))).otherwise(c), "default": lambda c, a: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(a)),
    "replace": lambda c, a: F.replace(c, F.lit(a[0]), F.lit(a[1])), "first": lambda c, a: F.get(F.split(c, re.escape(a or ",")), F.lit(0)), "dedupe": lambda c, a: F.array_join(F.array_distinct(F.split(c, re.escape(a or ","))), a or ","),
    "join": lambda c, a: F.array_join(F.split(c, re.escape(a[0])), a[1]), "map": lambda c, a: F.coalesce(F.create_map(*[F.lit(x) for kv in a.items() for x in kv])[c], c),
}


def field(spec: Any) -> Column:
    """Column of a field specification: a path, a list of fallback paths, {literal}, or {path, default, transforms}."""
    if isinstance(spec, str):
        return F.nullif(F.trim(path_column(spec)), F.lit(""))
    if isinstance(spec, list):
        return F.coalesce(*[field(s) for s in spec])
    if "literal" in spec:
        return F.lit(str(spec["literal"]))
    c = field(spec["path"])
    for t in spec.get("transforms", []):
        name, arg = (t, None) if isinstance(t, str) else next(iter(t.items()))
        c = TRANSFORMS[name](c, arg)
    return F.coalesce(c, F.lit(spec["default"])) if "default" in spec else c


def template(text: str) -> Column:
    """'{path}' texts filled in; a missing path is ''."""
    parts = re.split(r"\{([^{}]+)\}", text)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(path_column(p), F.lit("")) for i, p in enumerate(parts)])


def passes(rules: list[dict[str, Any]]) -> Column:
    """All rules hold: not_empty, empty, equals, not_equals, in, not_in, contains, regex, min, max over mapped or raw fields."""
    out = F.lit(True)
    for r in rules:
        c = path_column(r["field"]) if r.get("source") == "raw" else F.col(r["field"])
        v, text = r.get("value"), F.coalesce(c.cast("string"), F.lit(""))
        test = {
            "not_empty": lambda: F.trim(text) != "", "empty": lambda: F.trim(text) == "", "equals": lambda: text == str(v), "not_equals": lambda: text != str(v), "in": lambda: text.isin([str(x) for x in v]), "not_in": lambda: ~text.isin([str(x) for x in v]),
            "contains": lambda: F.lower(text).contains(str(v).lower()), "regex": lambda: text.rlike(java_regex({"pattern": v})), "min": lambda: F.coalesce(text.try_cast("double") >= float(v), F.lit(False)), "max": lambda: F.coalesce(text.try_cast("double") <= float(v), F.lit(False)),
        }[r["op"]]()
        out = out & test
    return out


def mapped(raw: DataFrame, config: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a raw JSON text column by mapping, defaults, computed, filters and required fields.

    rejected holds the raw text and the first missing field; text that is no JSON object is rejected as `invalid`.
    """
    text = raw.columns[0]
    df = raw.select(F.col(text).alias("_raw")).withColumn("_ok", F.try_parse_json("_raw").isNotNull() & F.ltrim("_raw").startswith("{"))
    df = df.select("_raw", "_ok", *[F.when(F.col("_ok"), field(s)).alias(n) for n, s in config["mapping"].items()])
    for n, v in config.get("defaults", {}).items():
        df = df.withColumn(n, F.coalesce(F.nullif(F.trim(F.col(n)), F.lit("")), F.lit(v)) if n in df.columns else F.lit(v))
    for n, t in config.get("computed", {}).items():
        df = df.withColumn(n, F.when(F.col("_ok"), template(t)))
    need = config.get("required", [])
    reason = F.coalesce(F.when(~F.col("_ok"), "invalid"), *[F.when(F.trim(F.coalesce(F.col(n), F.lit(""))) == "", F.lit(f"missing {n}")) for n in need], F.lit(None).cast("string"))
    df = df.withColumn("_reason", reason)
    good = df.where("_reason is null")
    if config.get("filters"):
        good = good.where(passes(config["filters"]))
    return good.drop("_raw", "_ok", "_reason"), df.where("_reason is not null").select(F.col("_raw").alias("raw"), F.col("_reason").alias("reason"))
