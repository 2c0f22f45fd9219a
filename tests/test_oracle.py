"""Every registered query against its SQL on the smallest tables; those without SQL must have rows."""

import oracle
import pytest

from loomspan.registry import registry

QUERIES = registry()


@pytest.fixture(scope="module")
def connection(data_dir):
    return oracle.connect(data_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, data_dir, name):
    query = QUERIES[name]
    if query.sql:
        assert oracle.differences(spark, connection, query, data_dir) == ""
    else:
        assert query.build(spark, data_dir).count() > 0
