"""The text operators' queries against their SQL on the smallest tables, and what each must be."""

import os

import pytest
from tests.oracle import compare, connect

from normatile.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF) == ""


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {f"op{n}_" for n in (2, 3, 4, 5, 8, 12, 13)} == {n.split("_")[0] + "_" for n in ORACLES}
