"""The driver's contract: every query with SQL gives the SQL's rows, the small fixtures' worth."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from fieldloom import ext_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | ext_queries.QUERIES, queries.ORACLE_SQL | ext_queries.ORACLE_SQL


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    mine = QUERIES[name](spark, data)
    theirs = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    rows = sorted((tuple(r[n] for n in sorted(names)) for r in mine.collect()), key=repr)
    other = sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in theirs.fetchall()), key=repr)
    assert rows == other


def test_without_what_the_training_part_needs(monkeypatch):
    """A module of its that cannot be imported leaves the other queries as they are."""
    import sys

    for name in [m for m in sys.modules if m.startswith("fieldloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(entry_module.queries()) == set(QUERIES) and set(entry_module.oracle_sql()) == set(ORACLE_SQL)
