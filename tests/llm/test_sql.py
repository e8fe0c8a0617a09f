"""Text operators' queries against their SQL."""

from __future__ import annotations

import pytest

from contagrid.llm.queries import ORACLE, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
