"""The operators whose rows SQL can express, against that SQL on the smallest tables."""

import pytest

from terravane.llm.queries import oracle_sql, queries

from ..compare import assert_same, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    assert_same(queries()[name](spark, FOLDER), connect(FOLDER), oracle_sql()[name])
