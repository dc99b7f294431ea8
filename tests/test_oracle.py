"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest

from lorebed import maintenance_queries  # noqa: F401 (registers its queries)
from lorebed.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck, same):
    found = QUERIES[name](spark, small)
    if name in SQL:
        same(found, duck.sql(SQL[name]))
    else:
        assert found.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
