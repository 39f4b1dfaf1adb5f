"""Every named query against its SQL counterpart on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from kartei.queries import all_queries
from oracle.statements import all_statements
from tools.check import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_a_statement():
    assert set(all_queries()) == set(all_statements())
    assert set(all_queries()) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, FOLDER).toArrow()
    assert difference(got, con.sql(oracle_sql()[name]).to_arrow_table()) == ""
    assert got.num_rows > 0


def test_entry(spark):
    assert entry(spark).count() > 0
