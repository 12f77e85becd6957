"""Personal information inside free text (problem 10).

Identifiers with a form of their own (mail addresses, phone and identity numbers, postal addresses) are found by
their form. Names have none: everything of the form of a name is a candidate, and what it discloses is learned from the
co-occurrence of terms in all documents, without any list of names or phrases. First the words that head candidates
beside identifiers: their pointwise mutual information with such places says how strongly they reveal a person. Then
the words to the left and right of candidates, by how often a revealing word follows or precedes them. Then the head
words again, by identifiers and revealing contexts together. A candidate is a mention if its head word or its context
exceeds the disclosure threshold; author citations after a taxon name need the context to the left. Mentions are generalised to
typed placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.session import checkpoint

_U, _L = "A-ZÀ-ÖØ-ÞĀ-Ž", "a-zß-öø-ÿā-ž"
# Titles, particles and the words of streets.
TITLES = "Dr|Prof|Mr|Mrs|Ms|Mme|M|Frau|Herr|Herrn|Sr|Sra|Dra|Dona|Dom"
PARTICLES = "van der|von der|van den|van|von|de la|della|del|de|di|da|dos|du|ter|ten|zu"
STREETS = "Street|St\\.|Road|Rd\\.|Lane|Ln\\.|Gate|Row|Terrace|Avenue|Ave\\.|Drive|Close|Court|Square|Hill|Way|Place|Crescent|Walk|Mews|Quay"

EMAIL = re.compile(
    r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[A-Za-z0-9-]+)*(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)[A-Za-z]{2,}"
    r"|(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]* at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+", re.I)
# An identity number: six or eight digits of a birth date and four more, three groups, or letters around digits.
_NUMBER = re.compile(r"\d\d\d(?:\d{5}-\d{4}|\d{3}/\d{4}|-\d{2}-\d{4}| \d{2} \d{4}|(?P<one>\d{3,5}[A-Za-z]?))")
_LETTERS = re.compile(r"(?<![A-Za-z])[A-Za-z]{1,2}$")
_BARE = re.compile(r"\d{8}-\d{4}|\d{6}/\d{4}")
_LABEL = re.compile(
    r"\b(?:SSN|passport(?: no\.| number)?|national ID(?: no\.)?|ID(?: no\.| number)?|Ausweisnummer|Ausweis(?:-Nr\.)?|Passeport|Pasaporte|Passaporte|Documento de identidad|Documento de identidade|DNI|NIF|CPF|RG|Steuer-ID|Personalausweis|identity (?:card|number)|tax ID)"
    r"(?:[ :#(]|n[º°]\.?|no\.)*$", re.I)
PHONE = re.compile(
    r"(?<![\w.,/+-])(?:"
    r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,8}){1,5}"
    r"|00\d{2}[ -]\d{2,5}(?:[ -]\d{2,8}){1,4}"
    r"|1-\d{3}-\d{3}-\d{4}"
    r"|\(\d{3}\)\s?\d{3}[ .-]\d{4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|0\d(?:\.\d{2}){4}"
    r"|0\d{2,4}/\d{3,8}(?:-\d{1,5})?"
    r"|0\d{4} \d{6}|0\d{4} \d{3} \d{3}"
    r")(?![\w/]|[.-]\d)")
_PLACE = rf"[{_U}][\w'-]*(?: [{_U}][\w'-]*)*"
_FLAT = re.compile(r"(?<![\w-])(?:Flat|Apt\.?|Apartment|Unit|Room|Wohnung) \w{1,5}, $", re.I)
#: Forms of postal addresses, each with the letters of which a text must hold some before the form is tried.
ADDRESSES = [
    (re.compile(rf"\d(?<![\w-]\d)\d{{0,3}}[a-z]? (?:(?!{STREETS})[{_U}][\w'-]* ){{1,3}}(?:{STREETS})(?![\w-]),? {_PLACE}(?: \d{{3,6}})?", re.I), tuple(w.replace("\\", "").lower() for w in STREETS.split("|"))),
    (re.compile(rf"\d(?<![\w-]\d)\d{{0,3}}[a-z]?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai) (?:(?:des|du|de la|de|d'|la) ?)*{_PLACE}, \d{{4,5}} {_PLACE}", re.I), ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "impasse ", "quai ")),
    (re.compile(rf"(?<![\w-])[{_U}][\w-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ufer) \d{{1,4}}[a-z]?,? \d{{4,5}} {_PLACE}", re.I), ("weg ", "straße ", "strasse ", "str. ", "gasse ", "platz ", "allee ", "ufer ")),
    (re.compile(rf"(?<![\w-])(?:Calle|C/|Avenida|Av\.|Plaza|Paseo|Rua|Travessa|Via|Viale|Largo|Praça) (?:(?:del|de la|de los|de|da|do|dos|das|delle|della|dei) )*{_PLACE},? (?:n[º°]\.? ?)?\d{{1,4}}[a-z]?(?:, \d{{1,2}}[º°ª] ?\w)?,? (?:\d{{4,5}}(?:-\d{{3}})? )?{_PLACE}", re.I), ("calle ", "c/ ", "avenida ", "av. ", "plaza ", "paseo ", "rua ", "travessa ", "via ", "viale ", "largo ", "praça ")),
]
_GIVEN, _WORD = rf"[{_U}][{_L}]+|[{_U}]{{2,}}", rf"[{_U}][\w{_L}'’]+"
_SURNAME = rf"(?:(?:{PARTICLES}) )?{_WORD}(?:-{_WORD})?"
FORWARD = re.compile(rf"(?<![\w.@-])(?P<given>(?:{_GIVEN})|[{_U}]\.)(?: ?[{_U}]\.){{0,2}} ?(?<=[ .])(?P<part>(?i:{PARTICLES}) )?(?P<last>{_WORD}(?:-{_WORD})?)")
BACKWARD = re.compile(rf"(?<![\w.@-])(?P<part>(?i:{PARTICLES}) )?(?P<last>{_WORD}(?:-{_WORD})?), (?P<given>(?:{_GIVEN})(?![\w@-])|[{_U}]\.)(?: ?[{_U}]\.)?")
# What stands before a cited author: a genus or epithets with Latin endings, perhaps with a bracket, or another author and a joint.
_GENUS, _ENDING = rf"[{_U}][{_L}-]*(?:us|um|a|is|es|on|os|ps|x|as)", "(?:us|um|a|is|e|ens|er|or|ps|es|on|os|i|ae|ns|x)"
_EPITHET = re.compile(rf"(?:^|[\s(-]){_GENUS}(?: \({_GENUS}\))?(?: (?:subsp\.|ssp\.|var\.|f\.|×|[{_L}-]+{_ENDING})){{0,3}} \(?$")
_JOINT = re.compile(rf"(?:[{_L}]|[{_U}]{{3,}}|\.)\)?(?:,? (?:&|et|ex|in)|,) $")
_TITLE_WORDS = frozenset(TITLES.split("|"))
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}


_DIGIT = re.compile(r"\d")


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of everything that has a form of its own; earlier kinds win where spans meet.

    A form is tried only on texts that hold the signs it cannot do without.
    """
    out: list[tuple[int, int, str]] = []

    def add(start: int, end: int, kind: str) -> None:
        if all(end <= s or start >= e for s, e, _ in out):
            out.append((start, end, kind))

    low = text.lower()
    if "@" in text or "at]" in low or "at)" in low or "at ]" in low or "at )" in low or (" dot " in low and " at " in low):
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if not _DIGIT.search(text):
        return out
    bare = []
    for m in _NUMBER.finditer(text):
        s, e = m.span()
        if m.group("one"):
            if not (letters := _LETTERS.search(text, max(0, s - 3), s)):
                continue
            s = letters.start()
        if e < len(text) and (text[e] == "/" or text[e] == "_" or text[e].isalnum()):
            continue
        if _LABEL.search(text, max(0, s - 48), s):
            add(s, e, "id_number")
        elif _BARE.fullmatch(text, s, e) and not (s and (text[s - 1] in "./-_" or text[s - 1].isalnum())) and not (e < len(text) and text[e] == "-"):
            bare.append((s, e))
    for s, e in bare:
        add(s, e, "id_number")
    for form, signs in ADDRESSES:
        if any(w in low for w in signs):
            for m in form.finditer(text):
                flat = _FLAT.search(text, max(0, m.start() - 20), m.start())
                add(flat.start() if flat else m.start(), m.end(), "address")
    for m in PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m.group())) <= 15:
            add(m.start(), m.end(), "phone")
    return out


def _cited(left: str) -> bool:
    """The words before are a taxon name or another cited author."""
    return bool(_EPITHET.search(left)) or bool(_JOINT.search(left))


def candidates(text: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, given, last, bare) of each span with the form of a name, forward and then reversed; bare leaves a particle to the words before."""
    for pattern, head in ((FORWARD, "given"), (BACKWARD, "last")):
        if pattern is BACKWARD and not _COMMA.search(text):
            continue
        at = 0
        while m := pattern.search(text, at):
            at = m.end(head)  # names may begin within a pair that is none
            if m.group("part") and pattern is BACKWARD:
                yield m.start("last"), m.end(), m.group("given"), m.group("last"), True
            yield m.start(), m.end(), m.group("given"), m.group("last"), False


_COMMA = re.compile(rf"[\w'’], [{_U}]")
_BREAK = re.compile(r"(?<=[.!?]) (?=\S)|\n(?!$)|\n\n")
_SIGN = re.compile(r"<\w+>|[^\W\d_]+[.:]?|\d+|[^\w\s]+|\n")
_STOP = re.compile(r"(?<=[.!?])\s|\n\n")


def _signs(words: list[str]) -> str:
    return " ".join("#" if w.isdigit() else w for w in words)


def spans(text: str) -> list[tuple]:
    """(start, end, kind, word, last, left, right, near, cited) of all identifiers and candidates, start counted from 0.

    word is the head word of a candidate ('' for an initial), left and right are the two words or signs beside it
    within its sentence, where identifiers count as signs of their kind; near says that one stands there or within
    six signs to the right.
    """
    ids = sorted(identifiers(text))
    out: list[tuple] = [(s, e, k, "", "", "", "", False, False) for s, e, k in ids]
    for s, e, given, last, bare in candidates(text):
        if given.title() in _TITLE_WORDS or not all(e <= a or s >= b for a, b, _ in ids):
            continue
        before = [(b, k) for _, b, k in ids if s - 60 < b <= s]
        after = [(a, k) for a, _, k in ids if e <= a < e + 60]
        plain = text[max(0, s - 60) : s]
        left = f"<{before[-1][1]}>" + text[before[-1][0] : s] if before else plain
        right = text[e : after[0][0]] + f"<{after[0][1]}>" if after else text[e : e + 60]
        lw = _SIGN.findall(_BREAK.split(left)[-1].strip("\n"))[-2:]
        rw = _SIGN.findall(_STOP.split(right)[0])[:6]
        near = any(w[0] == "<" and len(w) > 1 for w in (*lw, *rw))
        out.append((s, e, "person", "" if len(given.rstrip(".")) < 2 else given.title(), last.title(), _signs(lw), "" if bare else _signs(rw[:2]), near, bare or _cited(plain[-48:])))
    return out


_SPAN = "start int, end int, kind string, word string, last string, `left` string, `right` string, near boolean, cited boolean"


def scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text hash and spans of every document, in one pass, written once; candidates carry their place in the order of search."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, h, i, *x) for k, h, t in zip(b["key"], b["h"], b["text"]) for i, x in enumerate(spans(t))]
            yield pd.DataFrame(rows, columns=["key", "h", "nr", "start", "end", "kind", "word", "last", "left", "right", "near", "cited"]).astype({"nr": "int32", "start": "int32", "end": "int32"})

    plain = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    return checkpoint(plain.mapInPandas(run, f"key {kind}, h bigint, nr int, {_SPAN}"))


def disclosure(n: str, hits: str, counts: DataFrame) -> DataFrame:
    """counts with score: the pointwise mutual information of a term and the places that reveal, over the self-information of such a place.

    1 if the term stands in such places only, 0 if as often as any term, below 0 if less or never.
    """
    rate = counts.agg((F.sum(hits) / F.sum(n)).alias("rate"))
    lift = F.ln(F.col(hits) / F.col(n) / F.col("rate")) / -F.ln("rate")
    return counts.crossJoin(F.broadcast(rate)).withColumn("score", F.when(F.col(hits) > 0, F.when(F.col("rate") < 1, lift).otherwise(1.0)).otherwise(-1.0)).drop("rate")


def reveal(found: DataFrame, threshold: float = 0.45, context: float = 0.6, strict: float = 0.85, least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(word, score), (left), (right): the head words and contexts that disclose a person, learned from all candidates.

    A head word needs a score above `threshold` and `least` revealing places, and must not itself stand before such
    words a quarter of the time (it would be the end of a context). A context needs `least` candidates with a disclosing word and more than
    the share `context` (to the right, where any word may follow a name, `strict` and one more) of all its candidates in full.
    """
    shape = checkpoint(found.where("kind = 'person' and word <> ''").groupBy("word", "last", "left", "right", "near", "cited").agg(F.count(F.lit(1)).alias("n")))

    def words(hits: DataFrame) -> DataFrame:
        own = disclosure("n", "near", hits.where("not cited").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("near")))
        good = own.where((F.col("score") > threshold) & (F.col("near") >= least))
        before = shape.select("word", "last", "n").join(good.select(F.col("word").alias("last"), F.lit(True).alias("named")), "last", "left").groupBy("word").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("ahead"))
        return good.join(before.where("4 * ahead > `all`").select("word"), "word", "left_anti").select("word", "score", "n", "near")

    def contexts(side: str, given: DataFrame, share: float, some: int) -> DataFrame:
        c = shape.where(F.col(side) != "").join(given.select("word", F.lit(True).alias("named")), "word", "left").groupBy(side).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("named"), F.col("n")).otherwise(0)).alias("k"))
        return c.where((F.col("k") >= some) & (F.col("k") > share * (F.col("n") + 1))).select(side)

    given = checkpoint(words(shape.withColumn("hit", F.col("near"))))
    left, right = contexts("left", given, context, least), contexts("right", given, strict, least + 1)
    hits = shape.join(left.withColumn("l", F.lit(True)), "left", "left").join(right.withColumn("r", F.lit(True)), "right", "left").withColumn("hit", F.col("near") | F.coalesce("l", "r", F.lit(False)))
    given = checkpoint(words(hits))
    return given, checkpoint(contexts("left", given, context, least)), checkpoint(contexts("right", given, strict, least + 1))


def mentions(found: DataFrame, learned: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """key, h, spans: the mentions of each document in order; of overlapping candidates the first of the search counts.

    A candidate that is only revealed by its context may not begin with the end of a revealing context.
    """
    given, left, right = learned
    told = found.join(given.select("word", F.lit(True).alias("g")), "word", "left").join(left.withColumn("l", F.lit(True)), "left", "left").join(right.withColumn("r", F.lit(True)), "right", "left")
    names = given.select(F.col("word").alias("last"), F.lit(True).alias("early"))
    ends = left.select(F.element_at(F.split("left", " "), -1).alias("word"), F.lit(True).alias("cue")).distinct()
    told = told.join(names, "last", "left").join(ends, "word", "left")
    person = (F.coalesce("g", "r", F.lit(False)) & ~F.col("cited")) | F.coalesce("l", F.lit(False))
    kept = told.where((F.col("kind") != "person") | (person & (F.coalesce("g", F.lit(False)) | (F.col("early").isNull() & F.col("cue").isNull()))))
    one = kept.groupBy("key", "h").agg(F.array_sort(F.collect_list(F.struct("nr", "start", "end", "kind"))).alias("x"))
    free = lambda have, x: ~F.exists(have, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    none = F.array().cast("array<struct<nr:int,start:int,end:int,kind:string>>")
    # Identifiers never overlap and come first; each candidate is laid beside what is taken.
    chosen = F.aggregate("x", none, lambda have, x: F.when((x["kind"] != "person") | free(have, x), F.concat(have, F.array(x))).otherwise(have))
    return one.select("key", "h", F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("spans"))


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start_pos (from 1, in characters), end_pos of every mention.

    Null, empty and blank texts have none; a key that comes with several texts has the mentions of each, once.
    """
    found = scan(df, key, text)
    out = mentions(found, reveal(found)).select(F.col("key").alias(key), F.explode("spans").alias("x"))
    return out.select(key, F.col("x.kind").alias("kind"), (F.col("x.start") + 1).alias("start_pos"), F.col("x.end").alias("end_pos")).distinct()


def masked(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text with typed placeholders in place of all mentions; null stays null, the rest is untouched."""
    found = scan(df, key, text)
    places = mentions(found, reveal(found))
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    holder = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))
    built = F.aggregate("spans", start, lambda a, x: F.struct(F.concat(a["out"], F.substr(F.col("text"), a["last"] + 1, x["start"] - a["last"]), holder[x["kind"]]).alias("out"), x["end"].alias("last")), lambda a: F.concat(a["out"], F.substr(F.col("text"), a["last"] + 1)))
    both = docs.join(places.withColumnsRenamed({"key": "k2", "h": "h2"}), F.col("key").eqNullSafe(F.col("k2")) & (F.col("h") == F.col("h2")), "left")
    return both.select(F.col("key").alias(key), F.when(F.col("spans").isNull(), F.col("text")).otherwise(built).alias(text))
