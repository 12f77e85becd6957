"""The llm operators against brute force, round trips and edge cases: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.llm import bpe, entities, leaks, pii, survivors, unitext, variants


# --- problem 1 --------------------------------------------------------------------------------------------------
def test_splice_equals_whole_normalisation():
    rng = random.Random(1)
    pool = [chr(o) for o in [*range(0x20, 0x500), *range(0x1100, 0x1200), *range(0x1E00, 0x2000), *range(0xAC00, 0xAC40), *range(0xFF01, 0xFF60), *range(0x300, 0x330)]]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(12)))
        assert unitext.splice(s, lambda x: unicodedata.normalize("NFKC", x)) == unicodedata.normalize("NFKC", s)


@pytest.mark.parametrize("text,form,case", [
    ("Aus bus", "Aus bus", False), ("Aus  bus ", "Aus bus", False), ("Aus bus", "Aus bus", True), ("A​us", "Aus", True), ("Ａｕｓ", "Aus", True), ("аus", "aus", True), ("Юдин", "Юдин", False), ("А. Юдин", "А. Юдин", False), ("Aus О. Smith", "Aus O. Smith", True),
    ("aloë", "aloë", True), ("aloë", "aloë", False), ("Aus × bus", "Aus × bus", False), ("ﬂavus", "flavus", True), ("T𝖺nus", "Tanus", True), ("Филиппoвa", "Филиппова", True), ("", "", False), (None, None, False), ("x²", "x2", False), ("a­b", "ab", True), ("Βeta", "Beta", True),
])
def test_forms(text, form, case):
    assert unitext.canonical(text) == form and unitext.disguised(text) is case
    assert unitext.canonical(form) == form


def test_letters_of_all_scripts(spark):
    looks = unitext.all_looks(spark)
    assert len(looks) > 200 and all(len(v) == 1 and v.isascii() for v in looks.values())
    for text, form in (("Օsmunda", "Osmunda"), ("Ꭺcer", "Acer"), ("Ⲥarex", "Carex"), ("ꮪalix", "salix"), ("ᴏak", "oak"), ("Քարտեզ", "Քարտեզ"), ("ᏣᎳᎩ", "ᏣᎳᎩ"), ("Юдин", "Юдин"), ("日本 Aus", "日本 Aus")):
        assert unitext.canonical(text, looks=looks) == form and unitext.disguised(text, looks) is (text != form), text


def test_disguises_table(spark):
    df = spark.createDataFrame([("1", "A​us", "Aus", 1), ("1", "A​us", "Aus", 2), ("2", None, "", 3), ("3", "x" * 100_000 + " ", "y", 4)], "id string, scientific_name string, canonical_name string, value int")
    got = sorted((r.id, r.field_name) for r in unitext.disguises(df, "id", ["scientific_name", "canonical_name"]).collect())
    assert got == [("1", "scientific_name"), ("1", "scientific_name"), ("3", "scientific_name")]
    assert unitext.disguises(df.limit(0), "id", ["canonical_name"]).count() == 0
    assert [r[0] for r in df.select(unitext.canonical_column(F.col("scientific_name"))).limit(3).collect()] == ["Aus", "Aus", None]


# --- problem 8 --------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.VOCABULARY.replace(".tiktoken", ".json"))
    lib.encode_special_tokens = True
    texts = ["", " ", "Hello world, it's 1999!", "<|endoftext|>", "naïve façade 日本語 Юдин", "a" * 20_000, "  \n\n x\t", "😀👍🏽", None, "ab" * 5000]
    df = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)] + [(2, texts[2], [9])], "doc_id bigint, text string, ids array<int>")
    got = bpe.encode(df, "doc_id", "text").collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert list(r.ids) == (lib.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_merge_matches_the_plain_loop():
    rng = random.Random(2)
    ranks = {bytes([i]): i for i in range(256)}
    for n in range(300):
        a, b = rng.sample(list(ranks)[-60:] + [bytes([c]) for c in b"abc"], 2)
        ranks.setdefault(a + b, 256 + n)
    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if r == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]
    for _ in range(500):
        piece = bytes(rng.choice(b"abcxyz\xff") for _ in range(rng.randrange(1, 30)))
        if piece not in ranks:
            assert bpe.merge(piece, ranks) == plain(piece)


# --- problem 9 --------------------------------------------------------------------------------------------------
def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (p != t)))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(3)
    for _ in range(400):
        p, t = [rng.randrange(5) for _ in range(rng.randrange(1, 20))], [rng.randrange(5) for _ in range(rng.randrange(25))]
        assert leaks.distance(p, t) == slow_distance(p, t)


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(60))
    w = item.split()
    cases = {
        1: "before " + item + " after", 2: "x " + " ".join(w[10:25]) + " y", 3: " ".join(w[10:20]), 4: "A *" + "* ".join(x.upper() for x in w[30:50]) + "!", 5: " ".join("changed" if i % 7 == 3 else x for i, x in enumerate(w[:40])), 6: " ".join("no" if i % 3 == 0 else x for i, x in enumerate(w)),
        7: None, 8: "", 9: " ".join(w[:13]) + " quite other things follow here in this text", 10: "z " * 200_000 + " ".join(w[5:30]), 11: " ".join(x.replace("o", "о") for x in w[20:40]), 12: " ".join(x for i, x in enumerate(w[:30]) if i % 8 != 5),
    }
    docs = spark.createDataFrame([(k, v, k) for k, v in cases.items()] + [(1, cases[1], 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, "too short to count"), (9, None)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(k, 7) for k in (1, 2, 4, 5, 10, 11, 12)]
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text", block_chars=10).collect()) == got
    assert leaks.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0 and leaks.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_leaks_of_repeated_items(spark):
    w = [f"word{i}" for i in range(60)]
    revisions = [(n, " ".join("new" + str(n) if i == 4 * n + 1 else x for i, x in enumerate(w))) for n in range(5)]
    phrase = "explain your answer in two short sentences"
    stock = [(n, phrase + " " + " ".join(f"item{n}x{i}" for i in range(20))) for n in range(10, 16)]
    items = spark.createDataFrame([*revisions, *[(n, " ".join(w)) for n in range(5, 9)], *stock], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "see " + " ".join(w[25:45]) + " there"), (2, "please " + phrase + " now"), (3, stock[0][1])], "doc_id bigint, text string")
    for chars in (10, 1000, 8_000_000):
        got = sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text", block_chars=chars).collect())
        assert got == [*[(1, n) for n in range(9)], (3, 10)]


@pytest.mark.parametrize("copies", [1, 4, 400])
def test_equal_items_are_all_found(spark, copies):
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(30))) for n in range(copies)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "so " + " ".join(f"w{i}" for i in range(5, 25)))], "doc_id bigint, text string")
    assert {r.item_id for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == set(range(copies))


def test_short_items_have_a_budget_of_their_own(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma changed epsilon zeta eta theta y"), (2, "alpha beta no no epsilon zeta eta theta"), (3, "say one two three"), (4, "one two four")], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.leaks(docs, "doc_id", "text", items, "item_id", "text", short=True).collect()} == {(1, 1), (3, 2)}
    assert leaks.leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0


# --- problem 10 -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text,want", [
    ("mail a.b+c@x-y.example now", [("email", "a.b+c@x-y.example")]), ("or a_b [at] x dot y dot test.", [("email", "a_b [at] x dot y dot test")]), ("Call +49 30 23125 803.", [("phone", "+49 30 23125 803")]), ("tel. (305) 555 0187;", [("phone", "(305) 555 0187")]),
    ("SSN 991-45-2377;", [("id_number", "991-45-2377")]), ("Lot 944-12-4697 (dry)", []), ("Sheet no. L733744, doi:10.9943/KIR.1972.6757, 10.5-12.5 mm", []), ("live at Flat 3, 12 Mill Road, Tessen.", [("address", "Flat 3, 12 Mill Road, Tessen")]), ("bei Millweg 97, 74303 Sarrow.", [("address", "Millweg 97, 74303 Sarrow")]),
    ("call 555-123-4567 now", [("phone", "555-123-4567")]), ("Lot 555-123-4567-8", []), ("passport no. K1048472.", [("id_number", "K1048472")]), ("", []), ("  ", []),
])
def test_identifiers(text, want):
    assert [(k, text[s:e]) for s, e, k in sorted(pii.identifiers(text))] == want


GIVEN = "Rosa Marta Pavel Nils Clara".split()


def letters():
    """Texts with cues that no other text of the project uses, names in five spellings, places and cited authors."""
    out = []
    for i in range(60):
        g, s = GIVEN[i % 5], f"Vand{'aeiou'[i % 5]}{'klmnrst'[i % 7]}ik"
        out += [f"Ring up {g} {s} <x{i}@mail.test> tonight. We walked to Port Quillan and Halm Island.", f"The gate key lies with {g} {s} since May. North Ridge is wet, South Ridge dry.", f"The gate key lies with {g[0]}. {s} since June.", f"Ring up {s}, {g} <y{i}@mail.test> today. Compare Aus {'bcdf'[i % 4]}e{'lmnrst'[i % 6]}{'aeiou'[i % 5]}nus {g} {s}, 1900 with Aus d{'aeiou'[i % 5]}{'bcdfg'[i // 5 % 5]}us R. {s}."]
    return out


def test_names_are_learned_from_the_corpus(spark):
    texts = letters()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, " ", "x"), (903, "near Port Quillan. " * 3000, "x")], "doc_id bigint, text string, kind string")
    found = {}
    for r in pii.detect(df, "doc_id", "text").collect():
        found.setdefault(r.doc_id, set()).add((r.kind, texts[r.doc_id][r.start_pos - 1 : r.end_pos]))
    for i, t in enumerate(texts):
        n, g = i // 4, GIVEN[(i // 4) % 5]
        s = f"Vand{'aeiou'[n % 5]}{'klmnrst'[n % 7]}ik"
        want = [{("person", f"{g} {s}"), ("email", f"x{n}@mail.test")}, {("person", f"{g} {s}")}, {("person", f"{g[0]}. {s}")}, {("person", f"{s}, {g}"), ("email", f"y{n}@mail.test")}][i % 4]
        assert found[i] == want, t
    assert not any(k >= 900 for k in found)
    text = {r.doc_id: r.text for r in pii.masked(df, "doc_id", "text").collect()}
    assert text[0] == "Ring up [PERSON] <[EMAIL]> tonight. We walked to Port Quillan and Halm Island." and text[900] is None and text[901] == "" and text[902] == " " and len(text) == len(texts) + 4
    assert pii.detect(df.limit(0), "doc_id", "text").count() == 0 and pii.masked(df.limit(0), "doc_id", "text").count() == 0


# --- problem 7 --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text,want", [
    ("(Smith & Jones, 1900) Brown, A., C. Doe ex van der Berg", [("smith", "", "", False), ("jones", "", "", False), ("brown", "a", "", False), ("doe", "c", "", False), ("berg", "", "", False)]),
    ("R.Vargo.", [("vargo", "r", "", True)]), ("VonBerg, T.", [("berg", "t", "", False)]), ("Y. Ulmikqüist", [("ulmikquist", "y", "", False)]), ("Mikhail K. Jansel, [1980]", [("jansel", "mikhail", "k", False)]), ("", []), (None, []), ("1900", []),
])
def test_people(text, want):
    assert variants.people(text) == want


def test_average_linkage_matches_the_plain_method():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 12))
        s = rng.random((n, n))
        s = (s + s.T) / 2
        groups = [{i} for i in range(n)]
        while len(groups) > 1:
            best = max(((np.mean([s[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y))
            if best[0] < 0.55:
                break
            groups[best[1]] |= groups.pop(best[2])
        label = variants.average_linkage(s, 0.55)
        assert {frozenset(g) for g in groups} == {frozenset(i for i in range(n) if label[i] == c) for c in set(label)}


def test_link(spark):
    persons = spark.createDataFrame([(1, "Olga Setaviksky"), (2, "Lucia Stavovtveit"), (3, "Edward Stavovtveit"), (4, "Ignacio Ibilldottir"), (5, None)], "author_id bigint, full_name string")
    texts = ["Setaviksky, 1820", "O. Setavikksy", "P. Setaviksky", "Stavovtveit", "L. Stavovtveit & Stavovtveit, E.", "Setav.", "Nacho Ibilldottir ex Nobody", None, "", "Setaviksky, 1820", "x" * 5000]
    got = {}
    for r in variants.link(spark.createDataFrame([(t,) for t in texts], "a string"), "a", persons, "author_id", "full_name").collect():
        got.setdefault(r.text, set()).add(r.person)
    assert got == {"Setaviksky, 1820": {1}, "O. Setavikksy": {1}, "L. Stavovtveit & Stavovtveit, E.": {2, 3}, "Setav.": {1}, "Nacho Ibilldottir ex Nobody": {4}}
    assert variants.link(spark.createDataFrame([], "a string"), "a", persons, "author_id", "full_name").count() == 0


def test_short_names_and_short_forms(spark):
    persons = spark.createDataFrame([(1, "Olga Mora"), (2, "Robert Lindvane"), (3, "Robert Ostragg"), (4, "Clara Ostragg")], "author_id bigint, full_name string")
    texts = ["Mara", "Moro, 1900", "Omra", "Moraxx", "Bob Lindvane", "Lindvane, Bob", "Bob Ostragg, 1950", "Zed Ostragg"]
    got = {}
    for r in variants.link(spark.createDataFrame([(t,) for t in texts], "a string"), "a", persons, "author_id", "full_name").collect():
        got.setdefault(r.text, set()).add(r.person)
    assert got == {"Mara": {1}, "Moro, 1900": {1}, "Omra": {1}, "Bob Lindvane": {2}, "Lindvane, Bob": {2}, "Bob Ostragg, 1950": {3}}


# --- problem 5 --------------------------------------------------------------------------------------------------
def test_slips():
    assert entities.slip("abcd", "abdc") and entities.slip("abcd", "abd") and entities.slip("abcd", "abxd") and entities.slip("", "a") and not entities.slip("abcd", "badc") and not entities.slip("abcd", "ab")
    assert entities.slips("thoreblnud", "thoerblund") == 2


def test_match(spark):
    t = [("s1", "Gacubrugantes punctosus", "species", "Smith", "Plantae", "Fam1"), ("s2", "Gacubrugantes punctosus", "species", "Smith", "Plantae", "Fam1"), ("s3", "Gacubrugantes lanatus", "species", "Jones", "Plantae", "Fam1"), ("s4", "Helodruglaxon apoxeoides", "species", "Brown", "Animalia", "Fam2"), ("s5", "Helodruglaxon apoxeoides", "species", "", "Plantae", "Fam9"), ("s6", None, None, None, None, None), ("s7", "Mogedrathalla", "genus", "Doe", "Fungi", "Fam3")]
    t += [(f"f{i}", f"Filler{chr(97 + i % 26)}{chr(97 + i // 26)}genus {chr(97 + i % 7)}ordensis", "species", f"Author{i}", "Fungi", f"Family{i % 9}") for i in range(120)]
    taxa = spark.createDataFrame([(a, b, b, r, au, f, k) for a, b, r, au, k, f in t], "speciedex_id string, canonical_name string, scientific_name string, rank string, authorship string, family string, kingdom string")
    o = [("1", "Gacubrugantes punctosa", "species", "Smith, 1900", "plants", ""), ("2", "Gacubrugantes punctosus", "species", "Miller", "Plantae", "Fam1"), ("3", "G. lanatus", "species", "Jones", "Plantae", "Fam1"), ("4", "HELODRUGLAXON APOXEOIDES", "species", "", "Metazoa", None), ("5", "Gacubrugantes (Sub) lanatsu", "species", "Jones", "", ""), ("6", None, None, None, None, None), ("7", "Mogedrathala", "genus", "", "Mycota", "Fam3"), ("8", "Mogedrathalla", "species", "", "Fungi", "Fam3")]
    others = spark.createDataFrame([("p", i, n, n, r, au, f, k) for i, n, r, au, k, f in o + o[:1]], "provider string, provider_id string, canonical_name string, scientific_name string, rank string, authorship string, family string, kingdom string")
    got = {}
    for r in entities.match(taxa, others).collect():
        got.setdefault(r.provider_id, set()).add(r.speciedex_id)
        assert 0 < r.confidence < 1
    assert got == {"1": {"s1", "s2"}, "3": {"s3"}, "4": {"s4"}, "5": {"s3"}, "7": {"s7"}}
    assert entities.match(taxa.limit(0), others).count() == 0 and entities.match(taxa, others.limit(0)).count() == 0


def test_taxon_archived_in_many_records(spark):
    people = "Celtman Dramford Fostwick Gulpner Hirnsson Jalmberg Kestrup Lumbers Mordhaus Nesplund Pruxmann Quandt".split()
    columns = "canonical_name string, scientific_name string, rank string, authorship string, family string, kingdom string"
    taxa = [(f"t{n}", "Velmarothus grandiceps", None, "species", f"Thoreblund & {p}", "Borvidae", "Animalia") for n, p in enumerate(people)]
    taxa += [("t12", "Velmarothus grandiceps", None, "species", None, "Borvidae", "Animalia"), ("t13", "Velmarothus grandiceps", None, "species", None, None, None)]
    taxa += [(f"u{n}", f"Ostrenigula {w}", None, "species", None, None, "Plantae") for n, w in enumerate(["albida", "montana", "rubella", "fluvialis", "tenuis", "lucida"])]
    taxa = spark.createDataFrame(taxa, "speciedex_id string, " + columns)
    others = spark.createDataFrame([("p", "1", "Velmarothus grandiceps", None, "species", "Thoreblund", "Borvidae", "Animalia")], "provider string, provider_id string, " + columns)
    assert {r.speciedex_id for r in entities.match(taxa, others).collect()} == {f"t{n}" for n in range(14)}


COLUMNS = "canonical_name string, scientific_name string, rank string, authorship string, family string, kingdom string"


@pytest.mark.parametrize("copies", [1, 3, 300])
def test_a_repeated_misspelling_is_no_word(spark, copies):
    taxa = [(f"s{i}", f"Velmarothus {e}", None, "species", "Smith", "Borvidae", "Animalia") for i, e in enumerate("grandiceps albida montana rubella tenuis lucida hirsuta".split())]
    taxa += [(f"m{i}", "Velmarotus grandiceps", None, "species", f"Smith{'x' * i}", "Borvidae", "Animalia") for i in range(copies)]
    others = [("p", "1", "Velmarotus albida", None, "species", "Smith", "Borvidae", "Animalia")]
    got = entities.match(spark.createDataFrame(taxa, "speciedex_id string, " + COLUMNS), spark.createDataFrame(others, "provider string, provider_id string, " + COLUMNS))
    assert {r.speciedex_id for r in got.collect()} == {"s1"}


def test_every_agreeing_pair_is_retrieved(spark):
    rng = random.Random(6)
    genera = ["Velmarothus", "Ostrenigula", "Gacubrugantes", "Helodru"]
    ends = ["grandiceps", "albida", "campida", "campica", "rubella", "ulex"]

    def slip(w):
        i = rng.randrange(1, len(w))
        return rng.choice([w, w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "x" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]])

    def rec(i, noisy):
        g, e = rng.choice(genera), rng.choice(ends)
        g, e = (slip(g), slip(e)) if noisy else (g, e)
        g = g[0] + "." if rng.random() < 0.2 else g
        name = g if e == "ulex" and rng.random() < 0.3 else f"{g} {e}"
        return str(i), name.capitalize(), None, rng.choice(["species", "species", "genus"]), rng.choice(["Smith", "A. Thoreblund", "", None]), rng.choice(["Borvidae", "", "Fam"]), rng.choice(["Animalia", "Plantae", None])

    taxa = spark.createDataFrame([rec(i, i % 3 == 0) for i in range(60)], "speciedex_id string, " + COLUMNS)
    others = spark.createDataFrame([("p", *rec(i, True)) for i in range(60)], "provider string, provider_id string, " + COLUMNS)
    (_, docs), (_, queries) = entities.signatures(taxa, ["speciedex_id"]), entities.signatures(others, ["provider", "provider_id"])
    stand = entities.spellings(queries, docs)
    found = {(r.q, r.d) for r in entities.retrieve(entities.asked(queries, stand), entities.postings(docs)).collect()}
    stands = frozenset(f"{r.word}>{r.form}" for r in stand.collect())
    q, d = [(r.id, entities._plain(r)) for r in queries.collect()], [(r.id, entities._plain(r)) for r in docs.collect()]
    want = {(i, j) for i, x in q for j, y in d if entities.agreement(x, y, stands)}
    assert len(want) > 30 and want <= found
    words = {(r.kind, r.word, r.form) for r in stand.collect()}
    near = {(r.kind, r.word, s.form) for r in entities.words_of(queries).collect() for s in [t for t in stand.collect() if t.kind == r.kind] if entities.slip(r.word, s.form) and r.kind == "G"}
    assert {n for n in near if n[1] == n[2]} <= words


def test_given_names_that_go_under_another_initial(spark):
    rows = [(str(i), f"Velmarothus {e}", None, "species", a, "", "") for i, (e, a) in enumerate([("albida", "Dick Morland"), ("albida", "R. Morland"), ("rubella", "Dick Ostrag"), ("rubella", "Richard Ostrag"), ("tenuis", "Richard Lind"), ("tenuis", "R. Lind"), ("lucida", "Marta Lind"), ("lucida", None)])]
    recs = entities.signatures(spark.createDataFrame(rows, "speciedex_id string, " + COLUMNS), ["speciedex_id"])[1]
    alike = entities.given_forms(recs)
    assert ("dick", "r") in alike and ("marta", "l") not in alike and not any(a == "marta" for a, _ in alike)
    assert entities._same_person(("morland", "dick", "", False), ("morland", "r", "", False), alike) and not entities._same_person(("morland", "dick", "", False), ("morland", "m", "", False), alike)
    assert entities.given_forms(recs.limit(0)) == frozenset()


def test_nothing_is_broadcast_on_a_guessed_size(spark, monkeypatch, tmp_path):
    plans, cut = [], entities.checkpoint

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(entities, "checkpoint", lambda df: cut(plan(df)))
    taxa = spark.createDataFrame([("s1", "Velmarothus grandiceps", None, "species", "Dick Smith", "Borvidae", "Animalia")], "speciedex_id string, " + COLUMNS)
    others = spark.createDataFrame([("p", "1", "Velmarotus grandiceps", None, "species", "Smith", "Borvidae", "")], "provider string, provider_id string, " + COLUMNS)
    for name, df in (("taxa", taxa), ("others", others)):
        df.write.parquet(str(tmp_path / name))
    found = entities.match(spark.read.parquet(str(tmp_path / "taxa")), spark.read.parquet(str(tmp_path / "others")))
    assert [r.speciedex_id for r in plan(found).collect()] == ["s1"]
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("rows", [0, 3, 20, 5000])
def test_a_sample_is_cut_by_hash_before_it_is_ranked(spark, rows):
    pairs = spark.range(rows, numPartitions=16).select(F.col("id").alias("q"), (F.col("id") * 7).alias("d"), F.rand(1).alias("near"), F.rand(2).alias("gap"), (F.col("id") % 2 == 0).alias("same")).cache()
    want = [tuple(r) for r in pairs.orderBy(F.xxhash64("q", "d"), "q", "d").limit(20).select("near", "gap", "same").collect()]
    assert [tuple(r) for r in entities.drawn(pairs, rows, 20)] == want
    assert entities._below(pairs, 1.2 * 20 / max(rows, 1)).count() <= 60


def test_calibration_orders_and_falls_back():
    assert entities.calibrate([]) == entities.PRIOR
    rng = random.Random(1)
    rows = [(0.6 + 0.3 * rng.random(), 0.3 * rng.random(), True) for _ in range(200)] + [(0.3 + 0.3 * rng.random(), -0.3 * rng.random(), False) for _ in range(200)]
    c, near, gap = entities.calibrate(rows)
    p = lambda a, g: 1 / (1 + np.exp(-(c + near * a + gap * g)))
    assert p(0.9, 0.3) > 0.95 and p(0.3, -0.3) < 0.1 and 0.2 < p(0.6, 0.0) < 0.8


# --- problem 6 --------------------------------------------------------------------------------------------------
def assertion(provider, pid, sid, updated, wrap=0, cut=False, **fields):
    text = json.dumps(fields)
    for _ in range(wrap):
        text = json.dumps(text)
    text = text[:-3] if cut else text
    return provider, pid, sid, text, hashlib.sha256(text.encode()).hexdigest(), updated, 0


SCHEMA = "provider string, provider_id string, speciedex_id string, assertion_json string, assertion_hash string, updated_at string, trust int"


def test_survivors(spark):
    full = {"scientific_name": "A", "rank": "species", "family": "F"}
    rows = [
        assertion("P1 ", "1", "spx:sha256:AA", "2024-03-01T00:00:00Z", **full), assertion("p2", "2", "aa", "2024-01-01T00:00:00Z", **full), assertion("p1", "3", "aa", None, scientific_name="A", family="unknown"),
        assertion("p1", "4", "bb", "2024-01-01", wrap=2, **full), assertion("p2", "5", "bb", "2024-01-02", **full), assertion("p1", "6", "cc", "2024-01-01", **full), assertion("p1", "7", None, "2024-01-01", **full),
        assertion("p1", "8", "dd", "2024-01-01", cut=True, **full), assertion("p1", "9", "dd", "2024-01-01", scientific_name=" ", rank="?"), assertion("p1", "10", "ee", "2024-01-01", **full), assertion("p1", "11", "ee", "2024-01-01", **full),
    ]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    providers = spark.createDataFrame([("p1", 5), ("p2", 2)], "provider string, trust int")
    ranked = survivors.ranked_rows(df.drop("trust"), providers)
    assert {r.provider_id: r.filled for r in ranked.select("provider_id", "filled").collect()} == {"1": 3, "2": 3, "3": 1, "4": 3, "5": 3, "6": 3, "8": 0, "9": 0, "10": 3, "11": 3}
    claims = survivors.patterns(ranked)
    quality, prior = survivors.fit(claims)
    assert set(quality) == {"p1", "p2"} and all(0 < a < 1 and 0 < b < 1 for a, b in quality.values()) and 0 < prior < 1
    best = {r.key: (r.provider_id, r.rows, r.all_best) for r in survivors.best_rows(ranked, quality).collect()}
    assert best["aa"] == ("1", 3, True) and best["bb"][1:] == (2, False) and "cc" not in best and best["dd"][2] is False and best["ee"][2] is False
    values = survivors.true_values(ranked, claims, quality, prior, 0.0).collect()
    assert {(r.key, r.field) for r in values} >= {("aa", "scientific_name"), ("bb", "family")}
    empty = survivors.ranked_rows(df.drop("trust").limit(0), providers)
    assert survivors.fit(survivors.patterns(empty)) == ({}, 0.5) and survivors.best_rows(empty, {}).count() == 0


@pytest.mark.parametrize("wrap", [1, 3, 8, 14])
def test_text_coded_often_counts_as_its_content(spark, wrap):
    rows = [assertion("p1", "1", "aa", "2024-01-01", wrap=wrap, family="F", genus="G"), assertion("p1", "2", "aa", "2024-01-01", wrap=wrap, cut=True, family="F")]
    ranked = survivors.ranked_rows(spark.createDataFrame(rows, SCHEMA).drop("trust"), spark.createDataFrame([("p1", 5)], "provider string, trust int"))
    assert {r.provider_id: r.filled for r in ranked.collect()} == {"1": 2, "2": 0}


def test_records_are_built_field_by_field(spark):
    rows = [assertion(f"p{n}", str(n), "aa", f"2024-01-0{n}", family="Fine", genus="G" if n < 3 else "Wrong", rank="species") for n in range(1, 4)]
    rows += [assertion(f"p{n}", f"{n}{k}", f"k{k}", "2024-01-01", family="F", genus="G" if n < 3 else f"W{k}", rank="r") for k in range(30) for n in range(1, 4)]
    df, providers = spark.createDataFrame(rows, SCHEMA).drop("trust"), spark.createDataFrame([("p3", 5)], "provider string, trust int")
    best, judged, every = survivors.survive(df, providers)
    got = {r.key: r for r in survivors.resolved(every, best, judged).collect()}
    assert got["aa"].provider_id == "3" and got["aa"].all_best and got["aa"].record == {"family": ["Fine"], "genus": ["G"], "rank": ["species"]}
    best, judged, every = survivors.survive(df.limit(0), providers)
    assert survivors.resolved(every, best, judged).count() == 0


def test_em_finds_the_bad_source(spark):
    rng = random.Random(7)
    rows = []
    for e in range(300):
        truth = f"v{e}"
        for s, wrong, silent in (("good", 0.02, 0.1), ("fair", 0.15, 0.1), ("bad", 0.7, 0.1)):
            if rng.random() > silent:
                rows.append((s, str(e), str(e), json.dumps({"family": truth if rng.random() > wrong else f"w{rng.randrange(9)}"}), f"{s}{e}", "2024-01-01", 0))
    ranked = survivors.ranked_rows(spark.createDataFrame(rows, SCHEMA).drop("trust"), spark.createDataFrame([("good", 1)], "provider string, trust int"))
    claims = survivors.patterns(ranked)
    quality, prior = survivors.fit(claims)
    assert quality["good"][1] > quality["bad"][1] and quality["good"][0] > quality["bad"][0]
    kept = {(r.key, r.value) for r in survivors.true_values(ranked, claims, quality, prior).collect()}
    assert sum((str(e), f"v{e}") in kept for e in range(300)) > 250
