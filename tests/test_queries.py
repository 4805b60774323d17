"""All registered queries against their SQL twins, and the shape of their plans."""

import pytest

import oracle_check
from __spark_entry__ import entry, oracle_sql, queries
from pyspark.sql import functions as F

from almanack.plans.indicators import CHART_COLUMNS
from almanack.plans import catalog, oracles
from almanack.plans.panel import panel

# Queries of the optional subpackage have tests of their own beside its other tests.
QUERIES, SQL = dict(catalog.QUERIES), dict(oracles.ORACLES)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = oracle_check.connect(sf_dir)
    yield con
    con.close()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert oracle_check.check(spark, duck, sf_dir, name, QUERIES[name], SQL[name]) is None


SQL_TYPES = {
    "string": "VARCHAR",
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_sql(spark, duck, sf_dir, name):
    found = {c: SQL_TYPES[t] for c, t in QUERIES[name](spark, sf_dir).dtypes}
    assert found == {r[0]: r[1] for r in duck.execute("DESCRIBE " + SQL[name]).fetchall()}


def test_panel_follows_its_tables(spark, sf_dir, tmp_path):
    for name in ("customer", "nation", "region", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    people = lambda: panel(spark, str(tmp_path)).agg(F.sum("cumulative_enrollment")).first()[0]
    first = people()
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert people() == 2 * first


def test_entry(spark):
    df = entry(spark)
    assert df.columns == CHART_COLUMNS
    assert df.count() > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, sf_dir, name):
    plan = physical(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize(
    ("name", "pushed"),
    [
        ("in_list_filter", "PushedFilters"),
        ("regex_alternation_filter", "StringStartsWith(p_brand,Brand#1)"),
        ("positional_rename_union", "EqualTo(o_orderstatus,F)"),
        ("order_by_median", "ReadSchema: struct<p_brand:string,p_retailprice:double>"),
        ("set_membership_bucket", "ReadSchema: struct<p_partkey:bigint,p_size:int>"),
    ],
)
def test_scan_is_pruned(spark, sf_dir, name, pushed):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    full = QUERIES[name](spark, sf_dir)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in plan or pushed in full


def test_row_queries_do_not_shuffle(spark, sf_dir):
    for name in (
        "null_or_blank_filter", "in_list_filter", "not_in_null_safe", "recode_map", "coalesce_drift",
        "set_membership_bucket", "category_family", "lookup_left_join", "round_half_away",
        "select_range_cast", "select_prefix_unpivot", "html_nth_cell", "ingest_union_drift",
        "positional_rename_union", "empty_seed_union", "normalise_group_name",
    ):
        plan = physical(QUERIES[name](spark, sf_dir))
        shuffles = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]
        assert not shuffles, name
