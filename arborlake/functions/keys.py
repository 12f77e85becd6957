"""Comparable forms of ids, labels and times; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without surrounding blanks of any kind; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def filled(c: Column) -> Column:
    """True if the text holds anything but blanks; null gives false."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def record_id(c: Column, prefix: str = "spx:sha256:") -> Column:
    """Id without case, surrounding blanks and prefix; null where it refers to nothing."""
    bare = strip(F.regexp_replace(F.lower(strip(c)), "^" + prefix, ""))
    return F.when(F.length(bare) > 0, bare)


def label(c: Column) -> Column:
    """Label without case and surrounding blanks; null where blank."""
    low = F.lower(strip(c))
    return F.when(F.length(low) > 0, low)


def instant(c: Column) -> Column:
    """Timestamp of a text in extended or basic ISO notation; without an offset it is UTC; null if it is no time."""
    s = F.upper(strip(c))
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})[T ]+(\d{2})(\d{2})(\d{2})", "$1 $2:$3:$4")
    s = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2})$", "$1 00:00:00")
    s = F.when(s.rlike(r"(Z|[+-]\d{2}:\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    return s.try_cast("timestamp")
