"""The registered queries: names, SQL, and the modules' independence."""

import re

import pytest

from lorebed.llm import queries as own


def test_one_query_an_operator():
    assert sorted({int(re.match(r"op(\d+)_", name)[1]) for name in own.queries()}) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_sql(name, spark, small, duck, same):
    assert same(own.queries()[name](spark, small), duck.sql(own.oracle_sql()[name])) > 0
