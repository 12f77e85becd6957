"""Boolean, fielded, fuzzy search strings compiled to a match column and a score column.

Two dialects: `tree` (parentheses, OR below AND below NOT) and `linear` (strictly left to right, no parentheses).
The string is tokenised and parsed on the driver; everything that touches data is one expression tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.functions import coerce as C
from arborlake.plans.filterlang import facet, page_bounds, wildcard_regex

# Names under which a field may be asked for, where they differ from the field's own name.
ALIASES = {
    "id": "speciedex_id", "key": "speciedex_id", "sid": "speciedex_id", "speciedex": "speciedex_id", "scientific": "scientific_name", "canonical": "scientific_name", "accepted": "scientific_name",
    "common": "common_name", "vernacular": "common_name", "vernacular_name": "common_name", "synonym": "synonyms", "source": "provider", "nation": "country", "province": "state",
    "conservation": "conservation_status", "status": "conservation_status", "iucn": "iucn_status", "author": "authority", "checksum": "hash", "gbif": "gbif_id", "ncbi": "ncbi_id", "itis": "itis_id",
    "worms": "worms_id", "col": "col_id", "inat": "inat_id", "eol": "eol_id", "bold": "bold_id", "wikidata": "wikidata_id", "created": "created_at", "updated": "updated_at",
}
# The fields that free text looks into.
TEXT_FIELDS = (
    "speciedex_id scientific_name common_name name canonical_name accepted_name synonyms authority description keywords tags rank domain kingdom phylum class order family tribe genus species "
    "subspecies country state locality continent habitat biome ecosystem provider"
).split()
# Forms of bare identifiers and the field each belongs to.
IDENTIFIERS = [
    ("sha1", r"[a-f0-9]{40}"), ("sha256", r"[a-f0-9]{64}"), ("sha384", r"[a-f0-9]{96}"), ("sha512", r"[a-f0-9]{128}"), ("md5", r"[a-f0-9]{32}"),
    ("uuid", r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"), ("doi", r"10\.\d{4,9}/[-._;()/:a-z0-9]+"), ("wikidata_id", r"Q\d+"), ("speciedex_id", r"(?:spx|speciedex)[-_:][a-z0-9._:-]+"),
]
# Weights of fields in the score; all others count 1.
WEIGHTS = {8: ("speciedex_id", "uuid", "sha1", "sha256", "sha384", "sha512", "md5", "doi"), 7: ("scientific_name",), 6: ("common_name",), 4: ("genus", "species", "family", "order", "class", "phylum", "kingdom")}


# Fields that stand for several columns, where the record has no column of that name.
UNIONS = {
    "name": ["scientific_name", "common_name", "canonical_name", "accepted_name"],
    "location": ["continent", "country", "state", "province", "county", "city", "locality", "island", "ocean", "sea", "river", "lake"],
    "scientific_name": ["canonical_name", "accepted_name"], "common_name": ["vernacular_name", "preferred_common_name"], "speciedex_id": ["speciedex_key", "canonical_id", "id"],
}


class SearchError(ValueError):
    """The search string cannot be read."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, open, close
    text: str = ""
    quoted: bool = False
    regex: bool = False


@dataclass(frozen=True)
class Term:
    field: str | None
    op: str
    value: str
    regex: bool = False
    quoted: bool = False


@dataclass(frozen=True)
class Node:
    kind: str  # all, and, or, not, term
    parts: tuple = ()
    term: Term | None = None


def normalize_field(name: str, aliases: dict[str, str] = ALIASES) -> str:
    low = name.strip().lower().replace("-", "_")
    return aliases.get(low, low)


def tokenize(text: str) -> list[Token]:
    """Words, quoted strings (backslash escapes), /regex/flags and parentheses."""
    out, i, n = [], 0, len(text)
    while i < n:
        ch = text[i]
        if ch.isspace():
            i += 1
        elif ch in "()":
            out.append(Token("open" if ch == "(" else "close"))
            i += 1
        else:
            word, quoted, regex = [], False, False
            while i < n and not text[i].isspace() and text[i] not in "()":
                ch = text[i]
                starts = not word or word[-1] in ":=<>"
                if ch in "\"'" and starts:
                    end, got = i + 1, []
                    while end < n and text[end] != ch:
                        if text[end] == "\\" and end + 1 < n:
                            end += 1
                        got.append(text[end])
                        end += 1
                    if end >= n:
                        raise SearchError("Unclosed quoted string.")
                    word.append("".join(got))
                    quoted, i = True, end + 1
                elif ch == "/" and starts:
                    end = i + 1
                    while end < n and text[end] != "/":
                        end += 2 if text[end] == "\\" else 1
                    if end >= n:
                        raise SearchError("Unclosed regular expression.")
                    stop = end + 1
                    while stop < n and text[stop].isalpha():
                        stop += 1
                    word.append(text[i:stop])
                    regex, i = True, stop
                elif ch == "\\" and i + 1 < n:
                    word.append(text[i + 1])
                    i += 2
                else:
                    word.append(ch)
                    i += 1
            out.append(Token("word", "".join(word), quoted, regex))
    return out


_FIELDED = re.compile(r"^([A-Za-z_][\w-]*)(>=|<=|!=|=|>|<|:)(.+)$", re.S)


def parse_term(token: Token, aliases: dict[str, str] = ALIASES) -> Term:
    m = None if token.quoted and token.text[:1] not in "" and not _FIELDED.match(token.text) else _FIELDED.match(token.text)
    if m:
        return Term(normalize_field(m[1], aliases), m[2], m[3], token.regex, token.quoted)
    if not token.quoted and not token.regex:
        for name, pattern in IDENTIFIERS:
            if re.fullmatch(pattern, token.text, re.I):
                return Term(name, "=", token.text)
    return Term(None, ":", token.text, token.regex, token.quoted)


def parse(text: str, dialect: str = "tree", aliases: dict[str, str] = ALIASES) -> Node:
    """Syntax tree; an empty string matches all."""
    tokens = tokenize(text or "")
    if not tokens:
        return Node("all")
    return _parse_linear(tokens, aliases) if dialect == "linear" else _Parser(tokens, aliases).all()


class _Parser:
    def __init__(self, tokens: list[Token], aliases: dict[str, str]):
        self.tokens, self.at, self.aliases = tokens, 0, aliases

    def peek(self) -> Token | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def word(self, name: str) -> bool:
        t = self.peek()
        return bool(t and t.kind == "word" and not t.quoted and t.text.upper() == name)

    def all(self) -> Node:
        node = self.either()
        if self.peek():
            raise SearchError("Unexpected closing parenthesis.")
        return node

    def either(self) -> Node:
        parts = [self.both()]
        while self.word("OR"):
            self.at += 1
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.unary()]
        while (t := self.peek()) and t.kind != "close" and not self.word("OR"):
            if self.word("AND"):
                self.at += 1
            parts.append(self.unary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def unary(self) -> Node:
        t = self.peek()
        if t is None:
            raise SearchError("Unexpected end of the search.")
        if self.word("NOT"):
            self.at += 1
            return Node("not", (self.unary(),))
        self.at += 1
        if t.kind == "open":
            node = self.either()
            if not self.peek() or self.peek().kind != "close":
                raise SearchError("Unclosed parenthesis.")
            self.at += 1
            return node
        if t.kind == "close":
            raise SearchError("Unexpected closing parenthesis.")
        if not t.quoted and t.text.startswith("-") and len(t.text) > 1:
            return Node("not", (Node("term", term=parse_term(Token("word", t.text[1:], False, t.regex), self.aliases)),))
        return Node("term", term=parse_term(t, self.aliases))


def _parse_linear(tokens: list[Token], aliases: dict[str, str]) -> Node:
    node, joint, negate = None, "and", False
    for t in tokens:
        if t.kind != "word":
            continue
        if not t.quoted and t.text.upper() in ("AND", "OR"):
            joint = t.text.lower()
            continue
        if not t.quoted and t.text.upper() == "NOT":
            negate = not negate
            continue
        if not t.quoted and t.text.startswith("--"):
            continue
        text = t.text
        if not t.quoted and text.startswith("-") and len(text) > 1:
            negate, text = not negate, text[1:]
        leaf = Node("term", term=parse_term(Token("word", text, t.quoted, t.regex), aliases))
        leaf = Node("not", (leaf,)) if negate else leaf
        node = leaf if node is None else Node(joint, (node, leaf))
        joint, negate = "and", False
    return node or Node("all")


@dataclass
class Compiler:
    """Columns of a parsed search over the columns of df; text_fields are those that free text looks into."""

    df: DataFrame
    text_fields: list[str] = field(default_factory=list)
    fuzzy: bool = True
    mode: str = "record"  # record: per field; index: over all fields joined

    def __post_init__(self) -> None:
        if not self.text_fields:
            self.text_fields = [f for f in TEXT_FIELDS if f in self.df.columns] or [f.name for f in self.df.schema if isinstance(f.dataType, T.StringType)]

    def columns(self, name: str) -> list[str]:
        """Columns of a field: its own, its twin in camel case, or those of its union that are there."""
        camel = re.sub(r"_([a-z])", lambda m: m[1].upper(), name)
        return [name] if name in self.df.columns else [camel] if camel in self.df.columns else [c for c in UNIONS.get(name, []) if c in self.df.columns]

    def vals(self, name: str) -> Column:
        parts = [F.transform(C.values(self.df, c, "drop"), lambda x: x.cast("string")) for c in self.columns(name)]
        return parts[0] if len(parts) == 1 else F.flatten(F.array(*parts)) if parts else F.array().cast("array<string>")

    def kind(self, name: str) -> T.DataType:
        own = self.columns(name)
        return C.element_type(C.field_type(self.df, own[0])) if len(own) == 1 else T.StringType()

    def match(self, node: Node) -> Column:
        if node.kind == "all":
            return F.lit(True)
        if node.kind == "not":
            return ~self.match(node.parts[0])
        if node.kind in ("and", "or"):
            out = self.match(node.parts[0])
            for p in node.parts[1:]:
                out = (out & self.match(p)) if node.kind == "and" else (out | self.match(p))
            return out
        return self.leaf(node.term)

    def leaf(self, t: Term) -> Column:
        if t.field is None:
            if self.mode == "index":
                whole = F.lower(F.concat_ws(" ", *[F.array_join(self.vals(f), " ") for f in self.text_fields]))
                return self.text_hit(whole, t)
            out = F.lit(False)
            for f in self.text_fields:
                out = out | F.exists(self.vals(f), lambda x: self.text_hit(F.lower(x), t))
            return out
        if t.field == "has":
            return F.size(F.filter(self.vals(normalize_field(t.value)), lambda x: F.trim(x) != "")) > 0 
        if not self.columns(t.field):
            return F.lit(False)
        return C.two_valued(F.exists(self.vals(t.field), lambda x: self.field_hit(x, self.kind(t.field), t)))

    def text_hit(self, low: Column, t: Term) -> Column:
        if t.regex:
            m = re.fullmatch(r"/(.*)/([a-z]*)", t.value, re.S)
            return low.rlike("(?i)" + m[1])
        if not t.quoted and ("*" in t.value or "?" in t.value):
            return low.rlike(wildcard_regex(t.value))
        want = t.value.strip().lower()
        hit = low.contains(want)
        return hit | self.fuzzy_hit(low, want) if self.fuzzy and not t.quoted else hit

    @staticmethod
    def fuzzy_hit(low: Column, want: str) -> Column:
        if len(want) < 4:
            return F.lit(False)
        most = 1 if len(want) <= 6 else 2
        return F.exists(F.split(low, "[^a-z0-9._:-]+"), lambda w: F.levenshtein(w, F.lit(want), most) >= 0)

    def field_hit(self, x: Column, kind: T.DataType, t: Term) -> Column:
        low, value = F.lower(F.trim(x)), t.value.strip()
        if t.regex or (not t.quoted and ("*" in value or "?" in value)):
            hit = self.text_hit(F.lower(x), t)
            return ~hit if t.op == "!=" else hit
        want, n, own = value.lower(), C.literal_number(value) if value else None, C.number(x, T.StringType())
        if t.op == ":":
            hit = low.contains(want)
            return hit | self.fuzzy_hit(low, want) if self.fuzzy and not t.quoted else hit
        if t.op in ("=", "!="):
            if want in ("true", "false"):
                same = (low == "true") == F.lit(want == "true")
            elif n is not None:
                same = F.when(own.isNotNull(), own == F.lit(n)).otherwise(low == want)
            else:
                same = low == want
            return ~same if t.op == "!=" else same
        test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[t.op]
        by_text = test(C.natural_key(x), F.lit(C.literal_natural(value)))
        return F.when(own.isNotNull(), test(own, F.lit(n))).otherwise(by_text) if n is not None else by_text

    def positive(self, node: Node) -> list[Term]:
        if node.kind == "term":
            return [node.term]
        return [t for p in node.parts for t in self.positive(p)] if node.kind in ("and", "or") else []

    def score(self, node: Node) -> Column:
        """Sum over positive terms, fields and values: exact 10, beginning 6, within 3, near 1, times the field's weight."""
        out = F.lit(0)
        for t in self.positive(node):
            if t.regex or t.field == "has":
                continue
            want = t.value.strip().lower()
            for f in [t.field] if t.field else self.text_fields:
                near = self.fuzzy_hit if self.fuzzy else (lambda low, w: F.lit(False))
                points = F.aggregate(self.vals(f), F.lit(0), lambda a, x: a + F.when(F.lower(F.trim(x)) == want, 10).when(F.lower(F.trim(x)).startswith(want), 6).when(F.lower(x).contains(want), 3).when(near(F.lower(x), want), 1).otherwise(0))
                out = out + points * weight(f)
        return out


def weight(name: str) -> int:
    if name.endswith("_id"):
        return 8
    return next((w for w, names in WEIGHTS.items() if name in names), 1)


def terminal_score(comp: Compiler, node: Node, priority: dict[str, int], status: str | None = None, confidence: str | None = None) -> Column:
    """Score of the linear dialect: per clause the best field priority (40 more if exact), 15 if accepted, up to 10 by confidence."""
    out = F.lit(0.0)
    for t in comp.positive(node):
        want = t.value.strip().lower()
        best = [F.lit(0.0)]
        for f in [t.field] if t.field else comp.text_fields:
            if f in comp.df.columns:
                p = float(priority.get(f, 10))
                best.append(F.array_max(F.concat(F.array(F.lit(0.0)), F.transform(comp.vals(f), lambda x: F.when(F.lower(F.trim(x)) == want, p + 40.0).when(F.lower(x).contains(want), p).otherwise(0.0)))))
        out = out + F.greatest(*best, F.lit(0.0))
    if status:
        out = out + F.when(F.lower(F.col(status)) == "accepted", 15.0).otherwise(0.0)
    if confidence:
        out = out + F.least(F.lit(10.0), 10 * F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)))
    return F.when(comp.match(node), out).otherwise(0.0)


def search(df: DataFrame, query: str, sort: str | None = None, order: str = "asc", limit: int = 50, offset: int = 0, page: int = 1, fuzzy: bool = True, text_fields: list[str] | None = None, dialect: str = "tree", tie: list[str] = (), select: list[str] | None = None, mode: str = "record", facets: list[str] = ()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(page of matches with `score`, facets): by the sort field, or by score descending, then by tie."""
    comp = Compiler(df, text_fields or [], fuzzy, mode)
    node = parse(query, dialect)
    hits = df.where(comp.match(node)).withColumn("score", comp.score(node).cast("bigint"))
    start, size = page_bounds(limit, page, offset, 1000)
    keys = [C.ordering(F.col(sort), order == "desc")] if sort else [F.desc("score")]
    rows = hits.orderBy(*keys, *tie)
    rows = rows.offset(start).limit(size) if start else rows.limit(size)
    return (rows.select(*select) if select else rows), {f: facet(hits, f) for f in facets}


def postings(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """token, key, n: inverted index of the lower-case tokens of the fields; separators are all but a-z 0-9 . _ : -"""
    words = F.flatten(F.array(*[F.split(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), "[^a-z0-9._:-]+") for f in fields]))
    return df.select(F.col(key), F.explode(words).alias("token")).where("token <> ''").groupBy("token", key).agg(F.count(F.lit(1)).alias("n"))


def lookup(index: DataFrame, key: str, tokens: list[str], every: bool = True, prefix: bool = False) -> DataFrame:
    """Keys whose postings hold the tokens: all of them, or any; prefix looks for beginnings. Unknown tokens are ignored with `every`."""
    want = [t.lower() for t in tokens]
    hit = F.lit(False)
    for t in want:
        hit = hit | (F.col("token").startswith(t) if prefix else F.col("token") == t)
    rows = index.where(hit)
    which = F.array_compact(F.array(*[F.when(F.col("token").startswith(t) if prefix else F.col("token") == t, F.lit(t)) for t in want]))
    per = rows.select(key, F.explode(which).alias("t")).distinct()
    if not every:
        return per.select(key).distinct()
    known = per.agg(F.count_distinct("t").alias("k"))
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(known)).where("n = k").select(key)
