"""Each query of this subpackage that has SQL, against it."""

import pytest

from ferrule.llm import queries

from ..test_catalog import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(c.sql(queries.ORACLE_SQL[name]).df())
