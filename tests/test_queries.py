"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from tilewright.plans.catalogue import QUERIES, SQL, flagship

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[[repr(v) for v in table[n].to_pylist()] for n in names], strict=True))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, duck, name):
    ours = QUERIES[name](spark, DIR).toArrow()
    theirs = duck.sql(SQL[name]).arrow()
    theirs = theirs.read_all() if hasattr(theirs, "read_all") else theirs
    assert rows(ours) == rows(theirs)
    assert {f.name: str(f.type) for f in ours.schema} == {f.name: str(f.type) for f in theirs.schema}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_flagship(spark):
    assert flagship(spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
