"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from tallywright.plans.oracles import SQL
from tallywright.plans.queries import QUERIES
from tests.compare import connect, expected, rows


@pytest.fixture(scope="module")
def engine(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, engine):
    got = rows(entry.queries()[name](spark, sf_dir).toArrow())
    want = rows(expected(engine, entry.oracle_sql()[name]))
    assert got == want


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["tenant", "part", "position", "text"]
