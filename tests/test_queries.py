"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from tests.compare import duck_rows, spark_rows

from tallyforge.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NO_SQL = {"cell_search", "chunk_fields", "diversified_search", "embedded_search", "greedy_prototypes", "marker_chunks"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    other, expected = duck_rows(duck.sql(ORACLES[name]))
    assert names == other
    assert rows == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
