"""Variant spellings of names typed by people (problem 7).

Names are taken apart into surname, hint of the given name and marks of shortening. Surname spellings become
weighted character n-gram vectors; a sparse join over the rare grams of each vector finds all pairs above the cosine
that one slip of the keyboard leaves at least, a check of the slip follows, and average linkage of what remains around
each listed name decides which spellings belong to it. Shortened surnames are matched as prefixes. The hint of the
given name decides among persons; which short forms stand for which given name is learned from the surnames that they
occur with.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.llm.unitext import canonical
from arborlake.session import checkpoint, parallelism

# Particles before surnames.
PARTICLES = frozenset("van der den von de la del della di da dos du ter ten zu vander vonder".split())
_YEAR = re.compile(r"\b(1[5-9]\d\d|20\d\d)\b")
_JOINT = re.compile(r"\s*(?:&|;|\bex\b|\bet\b|\band\b|\bin\b|\bund\b|[()\[\]])\s*", re.I)
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?[\s-]?){1,3}$")
_TOKEN = re.compile(r"[^\W\d_][^\W\d_'’-]*\.?")


def fold(text: str) -> str:
    """Lower-case letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o")) if not unicodedata.combining(c) and (c.isalpha()))


def people(authorship: str | None, givens: frozenset[str] = frozenset()) -> list[tuple[str, str, str, bool]]:
    """(surname, given, middle initial, shortened) of each person in an authorship; folded; '' where there is no hint.

    A word of `givens` after a comma belongs to the surname before it.
    """
    if not authorship:
        return []
    text = _YEAR.sub(" ", canonical(authorship))
    out = []
    for group in _JOINT.split(text):
        parts: list[str] = []
        for piece in (p.strip(" ,") for p in group.split(",")):
            if not piece:
                continue
            if parts and _INITIALS.match(piece) and not _has_given(parts[-1]):
                parts[-1] += " , " + piece
            elif parts and re.fullmatch(r"[^\W\d_]{2,}(?: [^\W\d_]\.?)?", piece) and fold(piece.split()[0]) in givens and not _has_given(parts[-1]):
                parts[-1] += " , " + piece
            else:
                parts.append(piece)
        out += [p for s in parts if (p := _person(s))]
    return out


def _has_given(name: str) -> bool:
    words = _TOKEN.findall(name)
    return len([w for w in words if fold(w) not in PARTICLES]) > 1


def _person(name: str) -> tuple[str, str, str, bool] | None:
    reversed_ = " , " in name
    spaced = re.sub(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])|(?<=\.)(?=\w)", " ", re.sub(r"^[(\[]+|[)\]]+$", "", name))
    words = [w for w in _TOKEN.findall(spaced)]
    kept = [w for w in words if fold(w) not in PARTICLES]
    if not kept:
        return None
    single = [w for w in kept if len(w.rstrip(".")) == 1]
    long = [w for w in kept if len(w.rstrip(".")) > 1]
    if not long:
        return None
    if reversed_:
        cut = spaced.index(" , ")
        before = [w for w in _TOKEN.findall(spaced[:cut]) if fold(w) not in PARTICLES]
        after = _TOKEN.findall(spaced[cut:])
        surname, given = before[-1] if before else long[0], after[0] if after else ""
        middle = after[1] if len(after) > 1 else ""
    elif len(long) >= 2:
        surname, given = long[-1], long[0]
        middle = single[0] if single else ""
    else:
        surname = long[0]
        given, middle = (single[0] if single else ""), (single[1] if len(single) > 1 else "")
    return fold(surname), fold(given), fold(middle)[:1], surname.endswith(".")


def mentions(texts: DataFrame, text: str, givens: frozenset[str]) -> DataFrame:
    """text, surname, given, middle, short of each person named in each text; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, *p) for t in b[text] for p in people(t, givens)]
            yield pd.DataFrame(rows, columns=["text", "surname", "given", "middle", "short"]).astype({"text": str, "surname": str, "given": str, "middle": str, "short": bool})

    plain = texts.select(text).where(F.col(text).isNotNull()).distinct()
    # Parsing is dear and its input small, so it gets a partition a core however few bytes it has; the key differs from
    # that of distinct, whose exchange would else take its place and be merged by size.
    return plain.repartition(parallelism(texts.sparkSession), F.xxhash64(text)).mapInPandas(run, "text string, surname string, given string, middle string, short boolean")


def grams(form: Column, n: int = 2) -> Column:
    """Distinct character n-grams of a word with its edges marked."""
    edged = F.concat(F.lit("^"), form, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(edged) - (n - 1)), lambda i: F.substr(edged, i, F.lit(n))))


def vectors(forms: DataFrame) -> DataFrame:
    """form, g, w, before: unit tf-idf vector of each form, rare grams first, and the squared weight before each gram.

    Weights lie between 1 and 2 before scaling, which bounds what a slip can take away.
    """
    rows = forms.select("form", F.explode(grams(F.col("form"))).alias("g"))
    df = rows.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    total = forms.agg(F.count(F.lit(1)).alias("total"))
    w = rows.join(df, "g").crossJoin(F.broadcast(total)).select("form", "g", (1 + F.ln((F.col("total") + 1) / F.col("df")) / F.ln(F.col("total") + 1)).alias("w"))
    order = Window.partitionBy("form").orderBy(F.desc("w"), "g")  # one word's grams
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("form"))))
    return unit.withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def least_cosine(length: Column, cap: float = 0.35) -> Column:
    """The smallest cosine that one slip leaves to a word of the length: it changes at most three of its grams, all of the greatest weight beside the smallest."""
    kept = length + 1 - 3
    return F.when(kept < 1, 0.0).otherwise(F.least(F.lit(cap), (kept / (kept + F.lit(12.0)))))


def similar(unit: DataFrame, heads: DataFrame, cap: float = 0.35) -> DataFrame:
    """head, form, sim, v: all forms whose cosine with a head form is at least what a slip leaves to the head, or the cap.

    Two vectors with that cosine share a gram among the first ones of either, whose squared weights make up all but
    its square: only these meet in the join, so the grams of common endings never do for words of usual length. What
    a form needs is that of the shortest head it can come from.
    """
    least = least_cosine(F.length("form"), cap)
    first = unit.where(F.col("before") < 1 - least * least + 1e-9).select(F.col("form").alias("head"), "g").join(heads.select(F.col("form").alias("head")), "head", "left_semi")
    least = least_cosine(F.length("form") - 1, cap)
    pairs = first.join(unit.where(F.col("before") < 1 - least * least + 1e-9).select("form", "g"), "g").where(F.abs(F.length("head") - F.length("form")) <= 1).select("head", "form").distinct()
    whole = unit.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("v"))
    both = pairs.join(whole.select(F.col("form").alias("head"), F.col("v").alias("hv")), "head").join(whole, "form")
    dot = F.aggregate(F.map_entries("hv"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.col("v")[e["key"]], F.lit(0.0)))
    return both.select("head", "form", dot.alias("sim"), "v").where(F.col("sim") >= least_cosine(F.length("head"), cap) - 1e-9)


def average_linkage(sims: np.ndarray, threshold: float) -> list[int]:
    """Cluster number of each row of a symmetric similarity matrix, merged by mean similarity down to the threshold.

    Nearest-neighbour chains: clusters that are each other's nearest merge at once, which gives the tree of the
    sequential method in quadratic time, as average linkage is reducible; ties go to the smaller index.
    """
    n = len(sims)
    s = sims.astype(float).copy()
    np.fill_diagonal(s, -1.0)
    size, alive, label = np.ones(n), np.ones(n, bool), list(range(n))
    members = {i: [i] for i in range(n)}
    open_ = set(range(n))
    chain: list[int] = []
    while open_:
        if not chain:
            chain.append(min(open_))
        i = chain[-1]
        row = np.where(alive, s[i], -1.0)
        j = int(row.argmax())
        if len(chain) > 1 and row[chain[-2]] >= row[j]:
            j = chain[-2]
        if row[j] < threshold:
            open_.discard(i)  # no later merge can bring it nearer
            chain.pop()
        elif len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            s[a] = s[:, a] = (size[a] * s[a] + size[b] * s[b]) / (size[a] + size[b])
            s[a, a] = -1.0
            size[a] += size[b]
            alive[b] = False
            members[a] += members.pop(b)
            open_.discard(b)
            open_.add(a)
        else:
            chain.append(j)
    for a, rows in members.items():
        for r in rows:
            label[r] = a
    return label


def clusters(near: DataFrame, threshold: float = 0.2) -> DataFrame:
    """head, form: the forms that fall into one cluster with the head among those near to it.

    The forms given here are one slip from the head, and a word has at most some 55 such spellings a letter, so a
    group is bounded by the length of a name, not by the rows or the table. Every form is nearer to its head than the
    threshold on its own; two slips of one name are the less like each other the shorter it is, hence the low threshold,
    which for short names is half the cosine that a slip leaves.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("form", ignore_index=True)
        index = {g: i for i, g in enumerate(sorted({g for v in group["v"] for g in v}))}
        m = np.zeros((len(group), len(index)), np.float32)
        for r, v in enumerate(group["v"]):
            for g, w in dict(v).items():
                m[r, index[g]] = w
        head = group["head"][0]
        kept = max(len(head) - 2, 0)
        label = average_linkage(m @ m.T, min(threshold, kept / (kept + 12) / 2))
        own = [label[r] for r, f in enumerate(group["form"]) if f == head]
        kept = [f for r, f in enumerate(group["form"]) if own and label[r] == own[0]]
        return pd.DataFrame({"head": [head] * len(kept), "form": kept}).astype(str)

    return near.groupBy("head").applyInPandas(run, "head string, form string")


def typo(a: Column, b: Column) -> Column:
    """True if one word is the other with at most one letter replaced, added or left out, or two neighbours swapped."""
    # Two substitutions are a swap of neighbours if the words agree around two crossed letters.
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: (F.substr(a, i, F.lit(1)) == F.substr(b, i + 1, F.lit(1))) & (F.substr(a, i + 1, F.lit(1)) == F.substr(b, i, F.lit(1))) & (F.substr(a, F.lit(1), i - 1) == F.substr(b, F.lit(1), i - 1)) & (F.substr(a, i + 2) == F.substr(b, i + 2)),
    )
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swap)


def short_forms(named: DataFrame, persons: DataFrame, lead: float = 1.25) -> DataFrame:
    """hint, own_given: the given name for which a hint that is no listed given name stands.

    Each mention of the hint beside a listed surname speaks for the given names of its bearers, shared among them. The
    votes count up to twice where the hint has its letter pairs from the given name. The best given name is taken if
    it leads the next one by the factor `lead`; one mention is evidence if nothing speaks against it.
    """
    givens = persons.select(F.col("own_given").alias("given")).distinct()
    hints = named.where("length(given) > 1").join(givens, "given", "left_anti").groupBy("given", "surname").agg(F.count(F.lit(1)).alias("n"))
    bearers = persons.select(F.col("own").alias("surname"), "own_given").distinct()
    bearers = bearers.join(bearers.groupBy("surname").agg(F.count(F.lit(1)).alias("bearers")), "surname")
    same = F.size(F.array_intersect(grams(F.col("given")), grams(F.col("own_given")))) / F.size(grams(F.col("given")))
    votes = hints.join(bearers, "surname").groupBy("given", "own_given").agg(F.sum(F.col("n") / F.col("bearers")).alias("n")).select("given", "own_given", (F.col("n") * (1 + same)).alias("n"))
    top = votes.groupBy("given").agg(F.max(F.struct("n", "own_given")).alias("x"))
    rest = votes.join(top.select("given", F.col("x.own_given").alias("own_given")), ["given", "own_given"], "left_anti").groupBy("given").agg(F.max("n").alias("next"))
    return top.join(rest, "given", "left").where(F.col("x.n") > F.lit(lead) * F.coalesce("next", F.lit(0.0))).select(F.col("given").alias("hint"), F.col("x.own_given").alias("own_given"))


def _given_fits(hint: Column, given: Column, stands: Column) -> Column:
    full = (hint == given) | F.coalesce(stands, F.lit(False)) | ((F.length(hint) >= 4) & typo(hint, given))
    return F.when(F.length(hint) == 1, F.substr(given, F.lit(1), F.lit(1)) == hint).otherwise(full)


def link(texts: DataFrame, text: str, persons: DataFrame, key: str, name: str, bound: int = 1_000_000) -> DataFrame:
    """text, key: every listed person whom a distinct text names in any spelling.

    A full surname belongs to the listed name into whose cluster of spellings it falls; a shortened one (with a point)
    to those it begins. An initial, given name, short form or middle initial that the text gives must fit; without one
    the surname must belong to one listed person only. A mention that fits several persons names none. Null and blank
    texts and names give no row; repeated rows one. Given names of the list and learned short forms, at most `bound`
    each, go to the executors.
    """

    def words(df: DataFrame, what: str) -> frozenset[str]:
        rows = df.distinct().limit(bound + 1).collect()
        if len(rows) > bound:
            raise ValueError(f"more than {bound} {what}")
        return frozenset(r[0] for r in rows)

    listed = persons.select(F.col(key).alias("person"), F.col(name).alias("name")).where("person is not null").distinct()
    own = mentions(listed, "name", frozenset()).withColumnRenamed("text", "name").select("name", F.col("surname").alias("own"), F.col("given").alias("own_given"), F.col("middle").alias("own_middle"))
    people_ = checkpoint(listed.join(own, "name").withColumn("sharing", F.count(F.lit(1)).over(Window.partitionBy("own"))).drop("name"))
    givens = words(people_.select("own_given").where(F.length("own_given") > 1), "given names")
    named = checkpoint(mentions(texts, text, givens))
    short = checkpoint(short_forms(named, people_))
    hints = words(short.select("hint"), "short forms")
    if hints:
        # A learned short form after a comma was taken for a surname: such texts are parsed again.
        again = named.join(short.select(F.col("hint").alias("surname")).distinct(), "surname", "left_semi").where("given = ''").select("text").distinct()
        named = checkpoint(named.join(again, "text", "left_anti").unionByName(mentions(again, "text", givens | hints)))
    surnames = people_.select(F.col("own").alias("form")).distinct()
    forms = checkpoint(named.where("not short").select(F.col("surname").alias("form")).unionByName(surnames).distinct())
    near = similar(vectors(forms), surnames).where((F.col("head") == F.col("form")) | typo(F.col("form"), F.col("head")))
    grouped = clusters(near)
    same = checkpoint(grouped.join(surnames, "form", "left_anti").select("form", F.col("head").alias("own")).unionByName(surnames.select("form", F.col("form").alias("own"))).distinct())
    full = named.where("not short").join(same, named.surname == same.form).join(people_, "own")
    starts = people_.withColumn("form", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("own"), F.lit(2))), lambda n: F.substr("own", F.lit(1), n))))
    begun = named.where("short").join(starts, named.surname == starts.form)
    wanted = ["text", "surname", "given", "middle", "short", "person", "own_given", "own_middle", "sharing"]
    both = full.select(wanted).unionByName(begun.select(wanted)).distinct()
    both = both.join(short.select(F.col("hint").alias("given"), "own_given", F.lit(True).alias("stands")), ["given", "own_given"], "left")
    hint = F.col("given") != ""
    middle = (F.col("middle") == "") | (F.col("own_middle") == "") | (F.col("middle") == F.col("own_middle"))
    fits = both.where(F.when(hint, _given_fits(F.col("given"), F.col("own_given"), F.col("stands")) & middle).otherwise(F.col("short") | (F.col("sharing") == 1)))
    # Each mention names one person.
    one = fits.groupBy("text", "surname", "given", "middle", "short").agg(F.min("person").alias("person"), F.max("person").alias("other")).where("person = other")
    return one.select("text", "person").distinct()
