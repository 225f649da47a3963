"""Pages whose rows all stand at one height: the pitch has no mean to be measured by."""

import duckdb
import pytest
from compare import spark_rows, sql_rows

from folia import catalog

LINES = [(1, 4, 3, 2)] * 4 + [(2, 5, 2, n) for n in (1, 2, 3, 4)] + [(3, 7, 2, 2)] * 3 + [(3, 18, 3, 2)] * 2 + [(4, 4, 3, 5)] * 2 + [(5, 11, 2, 1), (5, 3, 1, 1), (5, 4, 1, 1), (5, 1, 1, 1)]


@pytest.mark.parametrize("name", ["row_assessment", "page_judgement", "page_findings", "page_issues"])
def test_flat_pages_equal_sql(spark, tmp_path, name):
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert spark_rows(catalog.queries()[name](spark, str(tmp_path))) == sql_rows(duck, catalog.oracle_sql()[name])


def test_infinite_variation(spark):
    from folia.operators.rows import variation

    rows = spark.createDataFrame([(1, 0.0), (1, 0.0), (2, -1.0), (2, 1.0), (3, 1.0), (3, 3.0), (4, None)], "k int, v double")
    got = {r.k: r.c for r in rows.groupBy("k").agg(variation("v").alias("c")).collect()}
    assert got[1] != got[1] and got[2] == float("inf") and got[3] == 0.5 and got[4] == 0.0
