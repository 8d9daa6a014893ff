"""Every query of the engine against its SQL."""

import pytest

from chronospan import queries as core

from .compare import HERE, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    columns, rows = spark_rows(core.QUERIES[name](spark, HERE))
    wanted_columns, wanted = sql_rows(core.ORACLE_SQL[name])
    assert columns == wanted_columns
    assert rows, "the query is empty here"
    assert rows == wanted
