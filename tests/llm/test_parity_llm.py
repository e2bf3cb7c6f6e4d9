"""Queries that SQL can express, against their SQL."""

import pytest
from parity import compare, connect

from kinweave.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_chat", "op7_exact_dedup", "op8_jaccard", "op12_collocations", "op13_minhash"])
def test_query_agrees_with_sql(spark, name):
    registry.load_all()
    _, problem = compare(spark, connect(SF), SF, name, registry.QUERIES[name], registry.ORACLES[name])
    assert problem is None, problem
