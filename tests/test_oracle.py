"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import canon, rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
LLM = {k for m in entry._MODULES if m.__name__.startswith("arborlake.llm") for k in m.QUERIES}


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LLM))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cur = db.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns and canon(0.5) == "0.5"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_gap_filling_counts_every_event(spark, db):
    got = entry.queries()["win_fill"](spark, DATA).collect()
    assert sum(r["count"] for r in got) == db.execute("SELECT count(*) FROM events WHERE ts IS NOT NULL").fetchone()[0]


def test_every_synonym_key_has_a_count(spark, db):
    got = {r.synonym_key for r in entry.queries()["jon_synonyms"](spark, DATA).collect()}
    assert {k.lower() for k, in db.execute("SELECT synonym_key FROM synonyms WHERE synonym_key IS NOT NULL").fetchall()} == got - {None}
