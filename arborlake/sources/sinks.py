"""Writers: volumes, change logs, delimited and JSON exports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_volumes(df: DataFrame, path: str, per_file: int = 100_000, order: list[str] = ()) -> None:
    """Append-only JSON volumes of at most `per_file` records, each file in order."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    rows.write.mode("append").option("maxRecordsPerFile", per_file).json(path)


def file_digests(spark, path: str) -> DataFrame:
    """path, bytes, sha256 of every file: the manifest that a later check compares with."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """path, problem (missing, unlisted, changed) of files that differ from their manifest."""
    now = file_digests(spark, path).select("path", F.col("sha256").alias("now"))
    j = manifest.select("path", "sha256").join(now, "path", "full_outer")
    return j.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("now") != F.col("sha256"), "changed").alias("problem")).where("problem is not null")


def _flat(df: DataFrame) -> list[Column]:
    return [F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields]


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, order: list[str] = (), limit: int | None = None, offset: int = 0, always_quote: bool = False) -> None:
    """Delimited export: nested cells as JSON text; ordered and paged if asked."""
    rows = df.select(*(columns or df.columns))
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(limit) if limit is not None else rows
    rows.select(*_flat(rows)).write.mode("overwrite").option("header", True).option("quoteAll", always_quote).option("escape", '"').option("lineSep", "\r\n" if always_quote else "\n").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def sorted_json(df: DataFrame) -> DataFrame:
    """Rows as compact JSON with sorted keys and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))


def write_text(df: DataFrame, path: str, fields: list[str]) -> None:
    """One 'field: value' block a row in the preferred order; blanks are left out."""
    lines = [F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", F.concat(F.lit(f + ": "), F.col(f).cast("string"))) for f in fields]
    df.select(F.concat_ws("\n", *lines, F.lit("")).alias("value")).write.mode("overwrite").text(path)


def prometheus(df: DataFrame, name: str, value: str, labels: list[str]) -> DataFrame:
    """Text exposition lines of a labelled series."""
    cells = F.concat_ws(",", *[F.concat(F.lit(l + '="'), F.regexp_replace(F.coalesce(F.col(l).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for l in labels])
    return df.select(F.concat(F.lit(name + "{"), cells, F.lit("} "), F.col(value).cast("string")).alias("line"))


def table_text(df: DataFrame, limit: int = 100, style: str = "markdown") -> str:
    """Rendered first rows; for display, so the limit is the feature."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(limit).collect()]
    if style == "html":
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        return "<table><tr>" + "".join(f"<th>{esc(c)}</th>" for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"
    esc = lambda s: s.replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(esc, r)) + " |" for r in rows]])


def quarantine(df: DataFrame, ok: Column, reason: Column, path: str) -> DataFrame:
    """The good rows; the others are appended to a reject log with their reason."""
    df.where(~F.coalesce(ok, F.lit(False))).withColumn("reason", reason).write.mode("append").json(path)
    return df.where(F.coalesce(ok, F.lit(False)))
