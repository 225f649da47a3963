"""Every registered query of the engine against its SQL, or at least its rows."""

import pytest
from compare import spark_rows, sql_rows

from folia import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    assert spark_rows(QUERIES[name](spark, data)) == sql_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "line_index", "rank", "diagonal", "score"]
