"""The queries of this subpackage that have SQL, on whole small tables."""

import oracle
import pytest

from loomspan.llm import queries
from loomspan.registry import Query


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, data_dir, name):
    assert oracle.differences(spark, oracle.connect(data_dir), Query(name, queries.QUERIES[name], queries.SQL[name]), data_dir) == ""
