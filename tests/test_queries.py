import pytest
from oracle import connect, rows_of_duckdb, rows_of_spark

from flowlens.plans import catalog, graphs, registry  # noqa: F401

SF = "/root/testdata/sf0.01"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    names, rows = rows_of_spark(df)
    assert rows, "empty"
    if name in registry.ORACLE_SQL:
        want_names, want, types = rows_of_duckdb(con, registry.ORACLE_SQL[name])
        assert names == want_names
        assert rows == want
        for column, kind in df.dtypes:
            assert KINDS.get(kind, kind.upper()) == types[column], column
