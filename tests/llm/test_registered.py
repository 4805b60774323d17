"""The registered queries: all present, and equal to their SQL where they have it."""

import duckdb
import oracle_check
import pytest

import __spark_entry__
from almanack.llm.queries import LLM_ORACLES, LLM_QUERIES


def test_every_operator_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(names)
    assert set(LLM_ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_its_sql(llm_spark, sf_dir, name):
    con: duckdb.DuckDBPyConnection = oracle_check.connect(sf_dir)
    assert oracle_check.check(llm_spark, con, sf_dir, name, LLM_QUERIES[name], LLM_ORACLES[name]) is None
