"""Every registered query of the subpackage, against its SQL where there is one, over the smallest tables."""

import os

import pytest
from test_queries import D, compare

from millrace.llm import queries, sql


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    if name in sql.oracle_sql():
        compare(spark, queries.queries(), sql.oracle_sql(), name)
    else:
        assert queries.queries()[name](spark, D).count() >= 0
