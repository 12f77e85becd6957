"""Visually identical text brought to one form (problem 1).

Quick-check properties say which characters can change under compatibility composition at all. A text's unstable
runs, each with the stable character before it as boundary context, are cut out, normalised and spliced back; the
rest is never touched. Letters of another script that pass for Latin ones are then settled word by word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Letters of other scripts and the Latin letters they look like, pairwise in the same order.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝѵӀҮ"
CYRILLIC_AS = "ABESIJKMHOPCTYXaesijopcyxdhqwvIY"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοιρυ"
GREEK_AS = "ABEZHIKMNOPTYXavoipu"
# Marks that pass for plain ones and are no compatibility forms.
MARKS = {"‐": "-", "‑": "-", "−": "-", "ʼ": "'", "ı": "i", "ɑ": "a", "ɡ": "g", "ǀ": "l", "ꓲ": "I", "∶": ":", "⁄": "/", "⁎": "*"}
LOOKS = {**dict(zip(CYRILLIC, CYRILLIC_AS)), **dict(zip(GREEK, GREEK_AS))}
BACK = {"CYRILLIC": {v: k for k, v in zip(CYRILLIC, CYRILLIC_AS)}, "GREEK": {v: k for k, v in zip(GREEK, GREEK_AS)}}
#: Compatibility forms that differ to the eye stay uncounted as look-alikes.
VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>")
SUSPECT = r"[^\x20-\x7e]"


def all_looks(spark: SparkSession) -> dict[str, str]:
    """LOOKS and every other letter of Unicode whose confusable prototype is one plain Latin letter.

    The prototypes are those of the Unicode confusables data, read in one call from the library for it that Spark
    ships; without a JVM on the driver only LOOKS. Greek and Cyrillic keep the fixed values, as the data also joins
    letters of these that differ to the eye.
    """
    if not hasattr(spark, "_jvm"):
        return LOOKS
    rest = [ch for o in range(0x250, 0x20000) if not (0x370 <= o < 0x530 or 0x1D2B <= o < 0x1D2C or 0x1E00 <= o < 0x2000 or 0x3400 <= o < 0xA000 or 0xAC00 <= o < 0xF900) and unicodedata.category(ch := chr(o)) in ("Lu", "Ll", "Lo", "Lm") and unicodedata.is_normalized("NFKC", ch)]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shown = checker.getSkeleton("\n".join(rest)).split("\n")
    found = {ch: "I" if p == "l" and unicodedata.category(ch) != "Ll" else p for ch, p in zip(rest, shown) if len(p) == 1 and p.isascii() and p.isalpha()}
    return {**found, **LOOKS} if len(shown) == len(rest) else LOOKS


def _class(codes: list[int]) -> str:
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}-\\U{codes[j]:08x}" if j > i else f"\\U{codes[i]:08x}")
        i = j + 1
    return "[" + "".join(out) + "]"


def invisible(ch: str) -> bool:
    """Shows nothing: format characters, controls, joiners, fillers and variation selectors."""
    o = ord(ch)
    return unicodedata.category(ch) in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


@lru_cache(maxsize=1)
def tables() -> tuple[re.Pattern, frozenset[str]]:
    """Pattern of an unstable run, and the characters whose quick check says no."""
    no, maybe = [], set()
    for o in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0x4E00 <= o <= 0x9FFF or 0x20000 <= o <= 0x2F7FF or o >= 0x30000 and o < 0xE0000:
            continue
        ch = chr(o)
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.is_normalized("NFC", ch):
            maybe.add(int(d.split()[1], 16))
        if not unicodedata.is_normalized("NFKC", ch):
            no.append(o)
        elif unicodedata.combining(ch) or 0x1161 <= o <= 0x1175 or 0x11A8 <= o <= 0x11C2:
            maybe.add(o)
        elif invisible(ch) or unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in MARKS:
            no.append(o)
    no += [*range(0x20), 0x7F, *range(0x80, 0xA0)]
    unstable = _class(sorted(maybe | set(no)))
    return re.compile(f"{unstable}+"), frozenset(map(chr, no))


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the unstable segments: each run with the stable character before it, on which its marks may sit."""
    for m in tables()[0].finditer(text):
        yield max(0, m.start() - 1), m.end()


def splice(text: str, change: Callable[[str], str]) -> str:
    """The text with its unstable segments changed and all the rest as it is."""
    out, last = [], 0
    for start, end in segments(text):
        start = max(start, last)
        out += [text[last:start], change(text[start:end])]
        last = end
    return "".join(out) + text[last:] if out else text


_WORD = re.compile(r"[^\W\d_]+")
_OTHER = re.compile("[\u0250-\u02af\u0370-\u1dff\u1f00-\u1fff\u2c00-\ud7ff\U00010000-\U0001ffff]")


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    o = ord(ch)
    return "LATIN" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "GREEK" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "CYRILLIC" if 0x400 <= o < 0x530 else unicodedata.name(ch, "OTHER").split()[0]


def _settle(text: str, looks: dict[str, str] = LOOKS) -> str:
    """Letters that only look Latin become Latin, or the other way round in a word that is truly of another script."""
    if not _OTHER.search(text):
        return text
    words = [(m.start(), m.group()) for m in _WORD.finditer(text)]
    kinds = [{"LATIN"} if w.isascii() else {_script(c) for c in w} for _, w in words]
    # A word is truly of a script if it has a letter of it that no Latin letter looks like.
    true = [{_script(c) for c in w if c not in looks} - {"LATIN"} for _, w in words]
    out, last = [], 0
    for i, (at, w) in enumerate(words):
        other = kinds[i] - {"LATIN"} | {_script(c) for c in w if c in looks}
        if not other:
            continue
        if true[i]:
            back = BACK.get(next(iter(true[i])), {}) if len(true[i]) == 1 else {}
            new = "".join(back.get(c, c) for c in w) if "LATIN" in kinds[i] and all(c in back for c in w if _script(c) == "LATIN") else w
        elif "LATIN" not in kinds[i] and any(other & t for t in true[max(0, i - 1) : i + 2]):
            new = w  # an initial or short word beside a word of the same script
        else:
            new = "".join(looks.get(c, c) for c in w)
        out += [text[last:at], new]
        last = at + len(w)
    return "".join(out) + text[last:]


def _run(segment: str) -> str:
    s = "".join(MARKS.get(c, c) for c in segment if not invisible(c) or c in "\t\n\r")
    s = unicodedata.normalize("NFKC", s)
    return "".join(" " if c == "\t" or unicodedata.category(c) in ("Zs", "Zl", "Zp") else c for c in s)


def canonical(text: str | None, blanks: bool = True, looks: dict[str, str] = LOOKS) -> str | None:
    """The one consistent form; `blanks` also makes each run of blanks one space and trims. None stays None."""
    if text is None:
        return None
    if not text.isascii() or not text.isprintable():
        text = _settle(splice(text, _run), looks)
    return " ".join(text.split()) if blanks else text


def disguised(text: str | None, looks: dict[str, str] = LOOKS) -> bool:
    """Holds a character or sequence that passes for ordinary text, or for nothing, but is another one."""
    if text is None or text.isascii() and text.isprintable():
        return False
    no = tables()[1]
    for start, end in segments(text):
        run = text[start:end]
        if not unicodedata.is_normalized("NFC", run) or any(c in no and not unicodedata.decomposition(c).startswith(VISIBLE) for c in run):
            return True
    plain = splice(text, _run)
    return _settle(plain, looks) != plain


def canonical_column(c: Column, looks: dict[str, str] = LOOKS) -> Column:
    """Consistent form of a text column. Plain ASCII never leaves the JVM: only suspect values go through Python."""
    def settled(s: pd.Series) -> pd.Series:
        return s.map(lambda t: canonical(t, looks=looks), na_action="ignore").astype(object)

    form = F.pandas_udf(settled, StringType())
    suspect = c.rlike(SUSPECT)
    plain = F.trim(F.regexp_replace(c, " +", " "))
    return F.when(suspect, form(F.when(suspect, c))).otherwise(plain)


def disguises(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field_name, value of each field that holds look-alike or invisible characters.

    Null, empty and plain values give no row; repeated rows are repeated; an empty table gives no rows.
    """
    looks = all_looks(df.sparkSession)

    def hides(s: pd.Series) -> pd.Series:
        return s.map(lambda t: disguised(t, looks), na_action="ignore").astype(object)

    told = F.pandas_udf(hides, BooleanType())
    cells = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("cell")).select(key, "cell.*")
    return cells.where(F.col("value").rlike(SUSPECT)).where(told("value"))
