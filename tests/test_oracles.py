"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tablewright.plans import article_queries, explain_queries, layout_queries, record_queries, repair_queries, run_queries, table_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query_equals_its_statement(spark, engine, name):
    df = table_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    spark.catalog.clearCache()
    if name in table_queries.ORACLES:
        result = engine.execute(table_queries.ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == plain([r[i] for i in order] for r in result.fetchall())
