"""Matching entities across sources without keys (problem 5).

Records of both tables become bags of tokens from all attributes: the full name, genus and epithets, people, family
and kingdom. The words of the asked names are first looked up in the vocabulary of the index: a word also stands for
those that it may misspell, unless it is itself an established word there. An inverted index then scores all
attributes by BM25. Only name tokens start candidates: a pair without one cannot pass the check of the names, whatever
its score, so the long lists of common attributes are read for no one and no match is lost; they only add to the score
of candidates. Each record takes the taxon that scores best, must be that taxon's nearest of its provider (or say
nothing against the nearest one), and gets a confidence from score and score gap by a logistic curve fitted to a
bounded sample.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from arborlake.llm import variants
from arborlake.llm.unitext import canonical
from arborlake.llm.variants import fold
from arborlake.session import checkpoint

# Words for the kingdoms, the marks of ranks inside names, and words for a value that is not known.
KINGDOMS = {w: k for k, ws in {"animalia": "animalia animals animal metazoa", "plantae": "plantae plants plant viridiplantae", "fungi": "fungi fungus mycota eumycota", "chromista": "chromista straminipila stramenopiles heterokonta"}.items() for w in ws.split()}
MARKS = frozenset("ssp. subsp. var. f. fo. forma subg. cf. aff. nr. sp. × x ssp subsp var".split())
UNKNOWN = frozenset(["", "unknown", "n/a", "?", "-", "not recorded", "incertae sedis", "none"])
PARTS = {"genus": 1, "species": 2, "subspecies": 3}
K1, B = 1.2, 0.3


def slip(a: str, b: str) -> bool:
    """At most one letter replaced, added or left out, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def slips(a: str, b: str) -> int:
    """Letters replaced, added, left out or swapped with their neighbour between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            best = min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y))
            if i and j and x == b[j - 1] and y == a[i - 1]:
                best = min(best, before[j - 1] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


def stem(epithet: str) -> str:
    """Epithet without the ending that changes with the gender of the genus."""
    s = re.sub(r"(?:us|um|is|a|e|i)$", "", epithet) if len(epithet) > 4 else epithet
    return re.sub(r"er$", "r", s)


def name_parts(name: str | None, full: str | None, rank: str | None) -> tuple[list[str], str]:
    """(words of the name, folded; the rest of the full name, which is the authorship)."""
    n = PARTS.get((rank or "").strip().lower(), 0)

    def split(text: str) -> tuple[list[str], str]:
        words, i, rest = [], 0, re.sub(r"[×_]", " ", canonical(text)).split()
        while i < len(rest) and (not n or len(words) < n):
            w = rest[i]
            if w.lower() in MARKS or (words and re.fullmatch(r"\([^\W\d_]+\)", w) and i + 1 < len(rest) and i == 1 and n > 1):
                i += 1
                continue
            if fold(w):
                words.append(fold(w) + ("." if w.endswith(".") else ""))
            i += 1
        return words, " ".join(rest[i:])

    by_full = split(full) if full and full.strip() else ([], "")
    if name and name.strip() and name.strip().lower() not in UNKNOWN:
        return split(name)[0], by_full[1]
    return by_full


def record(name: str | None, full: str | None, rank: str | None, authorship: str | None, family: str | None, kingdom: str | None) -> tuple:
    """rank, name words, people, family, kingdom of one record in comparable form."""
    words, rest = name_parts(name, full, rank)
    author = authorship if authorship and authorship.strip() and authorship.strip().lower() not in UNKNOWN else rest
    people = variants.people(author)
    fam = fold(canonical(family or "")) if (family or "").strip().lower() not in UNKNOWN else ""
    return (rank or "").strip().lower(), words, people, fam, KINGDOMS.get(fold(canonical(kingdom or "")), "")


def tokens(rec: tuple) -> dict:
    """The parts of a record that the index holds: g (genus in full), initial, last epithet and its stem, place (what stands for the name), attrs (all attributes).

    place tells a name that is in full (I) from a shortened one (J), so that shortened names meet both and full names
    do not read the lists of each other's initials.
    """
    rank, words, people, fam, kingdom = rec
    r, g = rank[:2], words[0]
    short = g.endswith(".")
    last = words[-1] if len(words) > 1 else ""
    s = stem(last.rstrip("."))
    attrs = [f"E:{stem(w)}" for w in words[1:]] + [f"a:{p[0][:4]}" for p in people] + ([f"f:{fam[:5]}"] if fam else []) + ([f"k:{kingdom}"] if kingdom else []) + ([] if short else [f"G:{g}"])
    by = [t for p in people for t in (f"a<{p[0][:4]}", f"a>{p[0][-4:]}")] + ([f"f:{fam[:5]}"] if fam else [])
    return {"r": r, "g": "" if short else g, "initial": g[0], "last": last, "s": s, "cut": last.endswith("."), "by": sorted(set(by)), "attrs": sorted(set(attrs))}


def _same_person(p: tuple, r: tuple, alike: frozenset = frozenset()) -> bool:
    """The names can be those of one person; alike holds (given name, other initial under which it goes too)."""
    (a, ag, am, ash), (b, bg, bm, bsh) = p, r
    if not (a == b or (ash and b.startswith(a)) or (bsh and a.startswith(b)) or (len(a) > 3 and slip(a, b)) or (min(len(a), len(b)) > 5 and slips(a, b) <= 2) or ((ash or bsh) and len(min(a, b, key=len)) > 3 and slip(a[: len(min(a, b, key=len))], b[: len(min(a, b, key=len))]))):
        return False
    if ag and bg:
        short = (len(ag) > 1 and (ag, bg[0]) in alike) or (len(bg) > 1 and (bg, ag[0]) in alike)
        if not short and (ag[0] != bg[0] if len(ag) == 1 or len(bg) == 1 else not slip(ag, bg)):
            return False
    return not (am and bm) or am == bm


def agreement(q: tuple, d: tuple, stands: frozenset[str], alike: frozenset = frozenset()) -> int:
    """0 if the records are not the same taxon, else 1 and one more for each agreeing author and family.

    stands holds "word>word" for each word of q (stems after the genus) that may misspell one of the index.
    """
    if q[0] != d[0] or not q[1] or not d[1] or (q[4] and d[4] and q[4] != d[4]):
        return 0
    if len(q[1]) != len(d[1]):
        return 0
    for i, (a, b) in enumerate(zip(q[1], d[1])):
        if a.endswith("."):
            if not b.startswith(a[:-1]):
                return 0
            continue
        if b.endswith("."):
            if not a.startswith(b[:-1]):
                return 0
            continue
        x, y = (a, b) if i == 0 else (stem(a), stem(b))
        if x != y and f"{a}>{y}" not in stands:
            return 0
    points = 1
    if q[2] and d[2]:
        if not any(_same_person(p, r, alike) for p in q[2] for r in d[2]):
            return 0
        points += 2
    if q[3] and d[3] and (q[3] == d[3] or slip(q[3], d[3])):
        points += 1
    if any(w.endswith(".") for w in (*q[1], *d[1])) and points < 2:
        return 0  # a shortened name needs an author or family beside it
    return points


def opposed(a: tuple, b: tuple, authors: bool, kingdoms: bool, alike: frozenset = frozenset()) -> bool:
    """Two records that name other authors or kingdoms, in what the taxon that both agree with does not say."""
    return bool(kingdoms and a[4] and b[4] and a[4] != b[4]) or bool(authors and a[2] and b[2] and not any(_same_person(p, r, alike) for p in a[2] for r in b[2]))


_REC = "rank string, words array<string>, people array<struct<surname:string,given:string,middle:string,short:boolean>>, family string, kingdom string"
_PARTS = "r string, g string, initial string, last string, s string, cut boolean, `by` array<string>, attrs array<string>"
_FIELDS = ["rank", "words", "people", "family", "kingdom"]
_SIDES = ["canonical_name", "scientific_name", "rank", "authorship", "family", "kingdom"]


def _plain(r: dict) -> tuple:
    return r["rank"], list(r["words"]), [(p["surname"], p["given"], p["middle"], p["short"]) for p in r["people"]], r["family"], r["kingdom"]


def signatures(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys with id, distinct records with id and parts): rows that say the same are one record.

    Records are told apart by a 128-bit digest of all they say; id is a row number of the written records.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            recs = [record(*(None if v is None else v for v in row)) for row in b[_SIDES].itertuples(index=False, name=None)]
            recs = [(r[0], r[1], sorted(set(r[2])), r[3], r[4]) for r in recs]
            b, recs = b[[bool(r[1]) for r in recs]], [r for r in recs if r[1]]
            made = [tokens(r) for r in recs]
            yield b[keys].assign(
                sig=[hashlib.blake2b(repr(r).encode(), digest_size=16).digest() for r in recs], rank=[r[0] for r in recs], words=[r[1] for r in recs],
                people=[[dict(zip(("surname", "given", "middle", "short"), p)) for p in r[2]] for r in recs], family=[r[3] for r in recs], kingdom=[r[4] for r in recs],
                **{c: [m[c] for m in made] for c in ("r", "g", "initial", "last", "s", "cut", "by", "attrs")},
            )

    plain = df.select(*keys, *_SIDES).distinct()
    parsed = checkpoint(plain.mapInPandas(run, f"{kinds}, sig binary, {_REC}, {_PARTS}"))
    rest = [c for c in parsed.columns if c not in keys and c != "sig"]
    recs = checkpoint(parsed.groupBy("sig").agg(F.first(F.struct(*rest)).alias("x")).select(F.monotonically_increasing_id().alias("id"), "sig", "x.*"))
    return _meet(parsed.select(*keys, "sig"), recs.select("sig", "id"), "sig").drop("sig"), recs.drop("sig")


def _meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by sorting and merging.

    No side here is small by nature, and the size that Spark guesses is that of the columns in their files, before records are parsed and
    words are cut and exploded; a join that broadcast a side on that guess would bring many times as much to the driver.
    """
    return left.hint("merge").join(right, on, how)


def words_of(recs: DataFrame) -> DataFrame:
    """kind, word, form of each distinct word of the names; form is the stem after the genus."""
    return recs.select(F.posexplode(F.transform("words", lambda w: F.struct(w.alias("word")))).alias("i", "w")).select(F.when(F.col("i") == 0, "G").otherwise("E").alias("kind"), F.col("w.word").alias("word")).where(~F.col("word").endswith(".")).distinct()


def _stem(word: Column) -> Column:
    cut = F.when(F.length(word) > 4, F.regexp_replace(word, "(us|um|is|a|e|i)$", "")).otherwise(word)
    return F.regexp_replace(cut, "er$", "r")


def _cuts(word: Column) -> Column:
    """The word and all it can be with one letter left out: two words one slip apart share one."""
    return F.array_union(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))))


def spellings(queries: DataFrame, docs: DataFrame, share: float = 0.05) -> DataFrame:
    """kind, word, form: the words (stems after the genus) of the index for which a word of the queries may stand.

    Each stands for itself. It also stands for those one slip away, unless it is an established word of the index: one
    that occurs with at least two other names' parts and with at least `share` as many as the word it would misspell.
    The measure counts different companions, not records, so copies of a misspelling do not make it a word, and it is
    relative, as slips repeat at random in a large table. Words meet by what is left of them without one letter.
    """
    form = lambda c: F.when(F.col("kind") == "G", F.col(c)).otherwise(_stem(F.col(c)))
    mine, theirs = words_of(queries), words_of(docs).withColumn("form", form("word"))
    ends = docs.where("g <> '' and s <> '' and not cut").select("g", "s").distinct()
    beside = ends.select(F.explode(F.array(F.struct(F.lit("G").alias("kind"), F.col("g").alias("form")), F.struct(F.lit("E").alias("kind"), F.col("s").alias("form")))).alias("x")).groupBy("x.kind", "x.form").agg(F.count(F.lit(1)).alias("n"))
    mine = mine.withColumn("own", form("word"))
    a = mine.select("kind", "word", "own", F.explode(F.array_union(_cuts(F.col("word")), _cuts(F.col("own")))).alias("cut"))
    b = theirs.select("kind", F.col("word").alias("other"), "form", F.explode(F.array_union(_cuts(F.col("word")), _cuts(F.col("form")))).alias("cut"))
    met = _meet(a, b, ["kind", "cut"]).where((F.col("own") == F.col("form")) | variants.typo(F.col("word"), F.col("other")) | variants.typo(F.col("own"), F.col("form"))).select("kind", "word", "own", "form").distinct()
    met = _meet(_meet(met, beside.withColumnsRenamed({"form": "own", "n": "n_own"}), ["kind", "own"], "left"), beside, ["kind", "form"], "left")
    met = met.where((F.col("own") == F.col("form")) | F.col("n_own").isNull() | (F.col("n_own") < 2) | (F.col("n_own") < share * F.coalesce("n", F.lit(0))))
    return met.select("kind", "word", "form").unionByName(mine.select("kind", "word", F.col("own").alias("form"))).distinct()


def given_forms(recs: DataFrame, share: float = 0.5, bound: int = 100_000) -> frozenset[tuple[str, str]]:
    """(given name, initial) of the given names that go under another initial than their own, learned from the records.

    Where records of one name and surname give just two given names or initials, these may be forms of one. A given
    name goes under the other initial if more than `share` of all its such pairs say so: those of a full name mostly
    show its own initial, those of a short form that of the full one, and persons who share a surname seldom describe
    the same names. At most `bound` pairs go to the executors.
    """
    said = recs.select("rank", "words", F.explode("people").alias("p")).select("rank", "words", "p.surname", "p.given").where("given <> ''")
    two = said.groupBy("rank", "words", "surname").agg(F.array_sort(F.collect_set("given")).alias("g")).where("size(g) = 2").select(F.explode(F.array(F.struct(F.col("g")[0].alias("a"), F.col("g")[1].alias("b")), F.struct(F.col("g")[1].alias("a"), F.col("g")[0].alias("b")))).alias("x"))
    pairs = two.select("x.a", F.substring("x.b", 1, 1).alias("b")).where("length(a) > 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.groupBy("a").agg(F.sum("n").alias("all"))
    rows = _meet(pairs, total, "a").where((F.col("n") > share * F.col("all")) & (F.col("b") != F.substring("a", 1, 1))).select("a", "b").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} given names")
    return frozenset((r.a, r.b) for r in rows)


def _hash(*parts) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, str) and len(p) == 1 and p.isupper() else F.col(p) if isinstance(p, str) else p for p in parts])


def postings(docs: DataFrame) -> DataFrame:
    """d, t, starts: the tokens of each record of the index; name tokens start candidates, attributes do not.

    Tokens are hashes; two that fall together add a candidate, which the check of the names refuses.
    """
    name = F.when(F.col("g") != "", F.concat(F.array(_hash("N", "r", "g", "s")), F.when(F.col("s") != "", F.array(_hash("P", "r", "g", F.substring("s", 1, 1)))).otherwise(F.array().cast("array<bigint>"))))
    side = F.transform("by", lambda x: F.when(F.col("g") != "", _hash("I", "r", "initial", "s", x)).otherwise(_hash("J", "r", "initial", "s", x)))
    starts = F.array_distinct(F.flatten(F.array(F.coalesce(name, F.array().cast("array<bigint>")), side)))
    return docs.select(F.col("id").alias("d"), starts.alias("starts"), F.transform("attrs", lambda x: F.xxhash64(F.lit("A"), x)).alias("attrs"))


def asked(queries: DataFrame, stand: DataFrame) -> DataFrame:
    """q, t, rate, own, kind: the tokens that each record asks for; those of a spelling it stands for count half a slip."""
    genus = stand.where("kind = 'G'").select(F.col("word").alias("g"), F.col("form").alias("g2"))
    ends = stand.where("kind = 'E'").select(F.col("word").alias("last"), F.col("form").alias("s2"))
    wide = _meet(_meet(queries.select("id", "r", "g", "initial", "last", "s", "cut", "by"), genus, "g", "left"), ends, "last", "left")
    wide = wide.withColumn("g2", F.coalesce("g2", "g")).withColumn("s2", F.coalesce("s2", "s"))
    rate = F.when(F.col("g2") == F.col("g"), 1.0).otherwise(0.5) * F.when(F.col("s2") == F.col("s"), 1.0).otherwise(0.5)
    none = F.array().cast("array<bigint>")
    full = F.when((F.col("g") != "") & ~F.col("cut"), F.array(_hash("N", "r", "g2", "s2"))).otherwise(none)
    cut = F.when((F.col("g") != "") & F.col("cut"), F.array(_hash("P", "r", "g2", F.substring("s", 1, 1)))).otherwise(none)
    short = F.transform("by", lambda x: _hash("J", "r", "initial", "s2", x))
    both = F.when(F.col("g") == "", F.concat(short, F.transform("by", lambda x: _hash("I", "r", "initial", "s2", x)))).otherwise(short)
    starts = wide.select(F.col("id").alias("q"), rate.alias("rate"), ((F.col("g2") == F.col("g")) & (F.col("s2") == F.col("s"))).alias("own"), F.lit("n").alias("kind"), F.explode(F.array_distinct(F.flatten(F.array(full, cut, both)))).alias("t"))
    attrs = queries.select(F.col("id").alias("q"), F.lit(1.0).alias("rate"), F.lit(True).alias("own"), F.explode("attrs").alias("x"))
    attrs = attrs.select("q", "rate", "own", F.substring("x", 1, 1).alias("kind"), F.xxhash64(F.lit("A"), "x").alias("t"))
    return starts.groupBy("q", "t").agg(F.max("rate").alias("rate"), F.max("own").alias("own"), F.first("kind").alias("kind")).unionByName(attrs, allowMissingColumns=False)


def retrieve(want: DataFrame, posts: DataFrame) -> DataFrame:
    """q, d, score, self, author, family: every record of the index that shares a name token with a query, scored by BM25 over all attributes.

    self is the score a record of the same words would have at most; author and family are the weights of these parts
    of the query.
    """
    total, mean = posts.agg(F.count(F.lit(1)), F.avg(F.size("starts") + F.size("attrs"))).first()
    every = posts.select("d", F.explode(F.concat("starts", "attrs")).alias("t"))
    lists = every.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    want = _meet(want, lists, "t", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    want = checkpoint(want.withColumn("w", (F.col("rate") * F.ln(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))).cast("float")))
    pairs = _meet(want.where("kind = 'n' and df > 0").select("q", "t"), posts.select("d", F.explode("starts").alias("t")), "t").select("q", "d").distinct()
    qs = want.groupBy("q").agg(
        F.sum(F.when(F.col("own"), F.col("w"))).alias("self"), F.max(F.when(F.col("kind") == "a", F.col("w"))).alias("author"), F.max(F.when(F.col("kind") == "f", F.col("w"))).alias("family"),
        F.map_from_entries(F.collect_list(F.when(F.col("df") > 0, F.struct("t", "w")))).alias("w"),
    )
    ds = posts.select("d", F.concat("starts", "attrs").alias("tokens"), (F.lit(K1 + 1) / (1 + F.lit(K1) * (1 - B + B * (F.size("starts") + F.size("attrs")) / F.lit(float(mean or 1))))).alias("f"))
    scored = _meet(_meet(pairs, qs, "q"), ds, "d")
    score = F.col("f") * F.aggregate(F.array_intersect(F.map_keys("w"), F.col("tokens")), F.lit(0.0), lambda a, t: a + F.col("w")[t])
    return scored.select("q", "d", score.alias("score"), F.greatest("self", F.lit(1e-6)).alias("self"), F.coalesce("author", F.lit(0.0)).alias("author"), F.coalesce("family", F.lit(0.0)).alias("family"))


#: Coefficients (constant, score share, gap) that the fit starts from and shrinks to where the sample says nothing.
PRIOR = (0.0, 2.0, 2.0)


def calibrate(rows: list[tuple[float, float, bool]], weight: float = 1.0, rounds: int = 25) -> tuple[float, float, float]:
    """Coefficients of the logistic curve of (score share, gap), by Newton steps with a normal prior around PRIOR."""
    mean = np.array(PRIOR)
    if not rows:
        return PRIOR
    x = np.array([(1.0, a, g) for a, g, _ in rows])
    y = np.array([float(t) for _, _, t in rows])
    beta = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - weight * (beta - mean)
        bend = (x * (p * (1 - p))[:, None]).T @ x + weight * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(b, 6)) for b in beta)


def _below(pairs: DataFrame, share: float) -> DataFrame:
    """The pairs whose hash h is within the lowest `share` of all hashes."""
    return pairs.withColumn("h", F.xxhash64("q", "d")).where(F.col("h") <= min(2**63 - 1, int(share * 2.0**64) - 2**63))


def drawn(pairs: DataFrame, count: int, sample: int) -> list[Row]:
    """near, gap, same of the `sample` pairs of the smallest hash, or of all `count` if there are fewer.

    Ranking sends `sample` rows of every task to the driver, so only hashes below a bound are ranked, within which a
    fifth more than asked are expected; if they are fewer, the bound is doubled.
    """
    share = 1.2 * sample / max(count, 1)
    while True:
        rows = _below(pairs, share).orderBy("h", "q", "d").limit(sample).select("near", "gap", "same").collect()
        if len(rows) >= min(sample, count):
            return rows
        share *= 2


def match(taxa: DataFrame, others: DataFrame, sample: int = 10_000) -> DataFrame:
    """speciedex_id, provider, provider_id, confidence of the pairs that are the same taxon at the same rank.

    Null and empty attributes are missing evidence; a record without a name or with an unknown rank matches by what
    it has. Repeated rows count once, and every id of a taxon archived more than once is matched. Among the candidates
    that pass the check of the names a record takes the taxon (name and kingdom) of the best score; of equal scores the
    greater name. Seen from the taxon, the record must be the nearest of its provider, or not be opposed to the nearest
    one in author or kingdom where the taxon gives none. The curve of the confidence is fitted to at most `sample` pairs that agree in name and
    author and as many that the check refuses, chosen by hash.
    """
    t_keys, t_recs = signatures(taxa, ["speciedex_id"])
    o_keys, o_recs = signatures(others, ["provider", "provider_id"])
    stand = checkpoint(spellings(o_recs, t_recs))
    alike = given_forms(t_recs.select("rank", "words", "people").unionByName(o_recs.select("rank", "words", "people")))
    posts = postings(t_recs)
    found = retrieve(asked(o_recs, stand), posts)
    slipped = stand.where(F.when(F.col("kind") == "G", F.col("word")).otherwise(_stem(F.col("word"))) != F.col("form"))
    over = _meet(o_recs.select(F.col("id").alias("q"), F.explode("words").alias("word")), slipped, "word").groupBy("q").agg(F.collect_set(F.concat("word", F.lit(">"), "form")).alias("stands"))
    qs = _meet(o_recs.select(F.col("id").alias("q"), F.struct(*_FIELDS).alias("qr")), over, "q", "left").withColumn("stands", F.coalesce("stands", F.array().cast("array<string>")))
    full = _meet(_meet(found, qs, "q"), t_recs.select(F.col("id").alias("d"), F.struct(*_FIELDS).alias("dr")), "d")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for q, d, score, whole, author, family, stands, qr, dr in b[["q", "d", "score", "self", "author", "family", "stands", "qr", "dr"]].itertuples(index=False, name=None):
                x, y = _plain(qr), _plain(dr)
                points = agreement(x, y, frozenset(stands), alike)
                # An author or family that agrees in another spelling counts as its token.
                if points >= 3 and not {p[0][:4] for p in x[2]} & {p[0][:4] for p in y[2]}:
                    score += author
                if points in (2, 4) and x[3][:5] != y[3][:5]:
                    score += family
                out.append((q, d, score / whole, points, y[4], " ".join([*y[1][:1], *map(stem, y[1][1:])]), points >= 3 and x[1] == y[1], not y[2]))
            yield pd.DataFrame(out, columns=["q", "d", "near", "points", "dk", "name", "sure", "bare"]).astype({"q": "int64", "d": "int64", "near": float, "points": "int32", "dk": str, "name": str, "sure": bool, "bare": bool})

    judged = checkpoint(full.mapInPandas(run, "q bigint, d bigint, near double, points int, dk string, name string, sure boolean, bare boolean"))
    best = judged.where("points > 0").groupBy("q").agg(F.max(F.struct("near", "dk", "name")).alias("best"))
    # All records of the best taxon stay, as it may be archived twice; the gap is the lead over the best other one.
    told = _meet(judged, best, "q", "left").withColumn("same", F.coalesce((F.col("points") > 0) & (F.col("name") == F.col("best.name")) & ((F.col("dk") == F.col("best.dk")) | (F.col("dk") == "") | (F.col("best.dk") == "")), F.lit(False)))
    other = told.where("not same").groupBy("q").agg(F.max("near").alias("next"))
    told = _meet(told, other, "q", "left").withColumn("gap", F.when(F.col("same"), F.col("near") - F.coalesce("next", F.lit(0.0))).otherwise(F.col("near") - F.coalesce("best.near", "next")))
    told = checkpoint(told.select("q", "d", "near", "gap", "same", "sure", "points", "bare", (F.col("dk") == "").alias("no_kingdom")))
    kinds = ("sure and same", "points = 0")
    counts = told.agg(*[F.count_if(F.expr(kind)) for kind in kinds]).first()
    shown = [r for kind, n in zip(kinds, counts) for r in drawn(told.where(kind), n, sample)]
    c, by_near, by_gap = calibrate([(r.near, r.gap, r.same) for r in shown])
    good = told.where("same").withColumn("confidence", 1 / (1 + F.exp(-(F.lit(c) + F.lit(by_near) * F.col("near") + F.lit(by_gap) * F.col("gap")))))
    pairs = checkpoint(_meet(good.select("d", "q", "near", "confidence", "bare", "no_kingdom"), o_keys.select(F.col("id").alias("q"), "provider").distinct(), "q"))
    top = pairs.groupBy("d", "provider").agg(F.max(F.struct("near", "q")).alias("top")).select(F.col("d").alias("d2"), F.col("provider").alias("p2"), F.col("top.q").alias("nearest"))
    seen = _meet(pairs, top, (F.col("d") == F.col("d2")) & F.col("provider").eqNullSafe(F.col("p2"))).drop("d2", "p2")
    side = o_recs.select(F.col("id"), F.struct(*_FIELDS).alias("rec"))
    rivals = seen.where("q <> nearest and (bare or no_kingdom)").select("q", "nearest", "bare", "no_kingdom").distinct()
    rivals = _meet(_meet(rivals, side.withColumnsRenamed({"id": "q", "rec": "a"}), "q"), side.withColumnsRenamed({"id": "nearest", "rec": "b"}), "nearest")

    def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[opposed(_plain(x), _plain(y), n, k, alike) for x, y, n, k in zip(b["a"], b["b"], b["bare"], b["no_kingdom"])], ["q", "nearest", "bare", "no_kingdom"]]

    mutual = _meet(seen, rivals.mapInPandas(against, "q bigint, nearest bigint, bare boolean, no_kingdom boolean"), ["q", "nearest", "bare", "no_kingdom"], "left_anti").select("d", "q", F.col("provider").alias("of"), "confidence")
    out = _meet(_meet(mutual, o_keys, (mutual.q == o_keys.id) & mutual.of.eqNullSafe(o_keys.provider)).drop("id"), t_keys, F.col("d") == t_keys.id)
    return out.groupBy("speciedex_id", "provider", "provider_id").agg(F.round(F.max("confidence"), 6).alias("confidence"))
