"""Dynamic-value rules as column expressions: numbers, text, times, natural order and null placement.

Every predicate made of these is closed to two values before it is negated.
"""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def two_valued(c: Column) -> Column:
    """False in place of null."""
    return F.coalesce(c, F.lit(False))


def number(c: Column, kind: T.DataType) -> Column:
    """Numeric value as dynamic scripts take it: '' is 0, true is 1, null is 0 only where the caller says so; null if not finite."""
    if isinstance(kind, NUMERIC):
        n = c.cast("double")
    elif isinstance(kind, T.BooleanType):
        n = c.cast("int").cast("double")
    elif isinstance(kind, TIMES):
        n = F.unix_millis(c.cast("timestamp")).cast("double")
    elif isinstance(kind, T.StringType):
        s = F.trim(c)
        n = F.when(s == "", 0.0).when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substr(s, F.lit(3)), 16, 10).try_cast("double")).when(s.rlike("^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"), s.try_cast("double"))
    else:
        return F.lit(None).cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def numeric(c: Column, kind: T.DataType) -> Column:
    """Statistics rule: numbers and numeric text count, booleans and blanks never do."""
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    n = number(c, kind)
    return F.when(F.trim(c) != "", n) if isinstance(kind, T.StringType) else n


def literal_number(v: Any) -> float | None:
    """The same rule for an operand."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v) if v == v and abs(v) != float("inf") else None
    if isinstance(v, str):
        s = v.strip()
        if s == "":
            return 0.0
        try:
            return float(int(s, 16)) if s.lower().startswith("0x") else (None if s.lower().lstrip("+-") in ("nan", "inf", "infinity") else float(s.replace("_", "x")))
        except ValueError:
            return None
    return None


def text(c: Column) -> Column:
    """Trimmed text, '' for null."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def folded(c: Column) -> Column:
    return F.lower(text(c))


def moment(c: Column, kind: T.DataType) -> Column:
    """Timestamp of a value: numbers are epoch milliseconds, text must hold one of - T : /."""
    if isinstance(kind, TIMES):
        return c.cast("timestamp")
    if isinstance(kind, NUMERIC):
        return F.timestamp_millis(c.cast("bigint"))
    if isinstance(kind, T.StringType):
        return F.when(c.rlike("[-T:/]"), F.translate(F.trim(c), "/", "-").try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def literal_moment(v: Any) -> str | None:
    if isinstance(v, datetime):
        return v.isoformat(" ")
    if isinstance(v, str) and any(x in v for x in "-T:/"):
        try:
            return datetime.fromisoformat(v.strip().replace("Z", "+00:00")).isoformat(" ")
        except ValueError:
            return None
    return None


def natural_key(c: Column) -> Column:
    """Sort key of text without case and accents in which runs of digits order by their value."""
    parts = F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "(?<=\\d)(?=\\D)|(?<=\\D)(?=\\d)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d+$"), F.lpad(p, 20, "0")).otherwise(p)), "")


def literal_natural(v: Any) -> str:
    import re

    return "".join(p.zfill(20) if p.isdigit() else p for p in re.split(r"(?<=\d)(?=\D)|(?<=\D)(?=\d)", str(v).lower()))


def field_type(df: DataFrame, path: str) -> T.DataType:
    """Type of a dotted path; null type where the path does not exist."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return T.NullType()
        kind = kind[part].dataType
    return kind


def values(df: DataFrame, path: str, nulls: str = "keep") -> Column:
    """Array of the values at a dotted path: arrays flattened, objects whole.

    nulls: `keep` keeps them (a missing leaf is one null), `drop` leaves them out, as the timeline does. A path
    that does not exist gives no values.
    """
    kind = field_type(df, path)
    if isinstance(kind, T.NullType) and path.split(".")[0] not in df.columns:
        return F.array().cast("array<string>")
    c = F.col(path)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        c, kind = F.flatten(c), kind.elementType
    out = F.coalesce(c, F.array().cast(kind)) if isinstance(kind, T.ArrayType) else F.array(c)
    return F.filter(out, lambda x: x.isNotNull()) if nulls == "drop" else out


def element_type(kind: T.DataType) -> T.DataType:
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    return kind


#: Where nulls stand: (ascending, descending).
NULL_ORDER = {"worker": ("last", "last"), "grid": ("first", "last"), "table": ("last", "first")}


def ordering(c: Column, descending: bool = False, policy: str = "worker") -> Column:
    """Sort column under one of the null policies."""
    where = NULL_ORDER[policy][descending]
    return {(False, "last"): c.asc_nulls_last, (False, "first"): c.asc_nulls_first, (True, "last"): c.desc_nulls_last, (True, "first"): c.desc_nulls_first}[descending, where]()
