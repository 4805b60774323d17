import math
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanack.operators import (
    Geography,
    alphabetical_order,
    append_series,
    at_latest,
    chain_latest,
    codebook_definitions,
    columns_between,
    columns_from,
    distinct_values,
    empty_like,
    exact_median,
    first_by,
    first_seen_order,
    fixed_order,
    geo_column,
    group_mean,
    group_names,
    group_sums,
    in_geography,
    lengthen,
    level_order,
    matches_any,
    measure_by_year,
    numbers_in,
    pooled_rate,
    share_of_total,
    stack,
    sums_by_name,
    widen,
    with_group_sums,
    with_levels,
)
from almanack.sources import literal_table

GEO = Geography("27", "Springfield County")


def rows(df, *columns):
    found = df.select(*columns) if columns else df
    return sorted(map(tuple, found.collect()), key=str)


@pytest.fixture(scope="module")
def dated(spark):
    return spark.createDataFrame(
        [("a", "2016"), ("a", "2017"), ("b", "2018"), ("a", None)], "k string, year string"
    )


def test_geography(spark):
    df = spark.createDataFrame(
        [("T", "00", "State"), ("C", "27", "Springfield"), ("C", "1", "x"), (None, "27", "y"), (None, None, None), ("D1", "027", "z")],
        "aggregate_level string, county_code string, county_name string",
    )
    kept = df.where(in_geography(GEO)).select("county_name", geo_column(GEO).alias("geo"))
    assert rows(kept) == [("Springfield", "Springfield"), ("State", "California"), ("y", None)]


def test_latest_before_or_after_siblings(spark, dated):
    a = F.col("k") == "a"
    assert rows(at_latest(dated, "year", a)) == []
    assert rows(chain_latest(dated, "year", a)) == [("a", "2017")]
    assert rows(at_latest(dated, "year")) == [("b", "2018")]


def test_strict_latest_keeps_nothing_when_a_year_is_missing(spark, dated):
    assert rows(at_latest(dated, "year", strict=True)) == []
    assert rows(chain_latest(dated, "year", F.col("k") == "b", strict=True)) == [("b", "2018")]


def test_latest_does_not_shuffle_rows(spark, dated):
    plan = at_latest(dated, "year")._jdf.queryExecution().executedPlan().toString()
    main = plan[: plan.index("Subquery")]
    assert "Exchange" not in main and "Join" not in main


def test_matches_any_and_first(spark):
    df = spark.createDataFrame([(2, "Riverton"), (1, "Northfield Union"), (3, "Other")], "i int, d string")
    assert rows(df.where(matches_any("d", ["Northfield", "River"])), "i") == [(1,), (2,)]
    assert rows(first_by(df, "i", "d")) == [("Northfield Union",)]


def test_lookup_keeps_unknown_codes(spark):
    df = spark.createDataFrame([("RB",), ("ZZ",), (None,)], "reporting_category string")
    named = group_names(df)
    assert rows(named) == [("RB", "African American"), ("ZZ", None), (None, None)]
    assert "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()


def test_codebook_compares_text(spark):
    book = literal_table(
        spark,
        [("CAASPP", "1", "All"), ("CAASPP", "003", "Padded"), ("SUSP", "3", "Other table")],
        "table string, value string, definition string",
    )
    df = spark.createDataFrame([(1,), (3,)], "Subgroup_ID int")
    assert rows(codebook_definitions(df, book, "CAASPP", "Subgroup_ID")) == [(1, "All"), (3, None)]


SUMS = [("a", 1, 2), ("a", 3, None), ("b", 5, 6), (None, 7, 8), (None, 1, 1)]


def test_group_sums_strict_and_lenient(spark):
    df = spark.createDataFrame(SUMS, "k string, x int, y int")
    assert rows(group_sums(df, ["k"], {"x": "x", "y": "y"})) == [
        ("a", 4, None), ("b", 5, 6), (None, 8, 9),
    ]
    assert rows(group_sums(df, ["k"], {"y": "y"}, strict=False)) == [("a", 2), ("b", 6), (None, 9)]


def test_group_sums_of_a_hot_group_are_spread(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("x")
    )
    out = with_group_sums(df, ["k"], {"total": "x"}, salts=8)
    wanted = sum(i for i in range(20_000) if i % 10)
    assert out.where("k = -1").select("total").distinct().collect() == [(wanted,)] and out.count() == 20_000
    assert out.where("k >= 0 AND total <> x").count() == 0


@pytest.mark.parametrize("salts", [1, 3, 16])
def test_group_sums_on_rows(spark, salts):
    df = spark.createDataFrame(SUMS, "k string, x int, y int")
    out = with_group_sums(df, ["k"], {"total": "x"}, salts=salts)
    assert rows(out, "k", "x", "y", "total") == sorted(
        [("a", 1, 2, 4), ("a", 3, None, 4), ("b", 5, 6, 5), (None, 7, 8, 8), (None, 1, 1, 8)], key=str
    )


def test_sums_by_name_keeps_missing_totals(spark):
    df = spark.createDataFrame(SUMS, "k string, x int, y int")
    assert rows(sums_by_name(df, "k", {"X": "x", "Y": "y"})) == sorted(
        [("a", "X", 4), ("a", "Y", None), ("b", "X", 5), ("b", "Y", 6), (None, "X", 8), (None, "Y", 9)], key=str
    )


def test_measure_by_year_and_pool(spark):
    df = spark.createDataFrame(
        [("2016", 1.0, 10.0), ("2016", 3.0, 30.0), ("2017", 1.0, 0.0)], "academic_year string, n double, d double"
    )
    assert rows(measure_by_year(df, "n")) == [("2016", 4.0), ("2017", 1.0)]
    assert rows(pooled_rate(df, ["academic_year"], "n", "d"), "academic_year", "rate") == [
        ("2016", 0.1), ("2017", None),
    ]
    assert rows(distinct_values(df, "academic_year")) == [("2016",), ("2017",)]


def test_column_choice(spark):
    df = spark.createDataFrame([(1, "2", "*", "4")], "a int, B1 string, b2 string, c string")
    assert columns_between(df, "B1", "c") == ["B1", "b2", "c"]
    assert columns_from(df, "b") == ["B1", "b2"]
    assert rows(numbers_in(df, ["a", "B1", "b2"])) == [(1.0, 2.0, None, "4")]


def test_lengthen_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, x double, y double")
    wanted = [(1, "x", 2.0), (1, "y", None)]
    assert rows(lengthen(df, ["x", "y"])) == wanted
    assert rows(lengthen(df, None, ["id"])) == wanted
    with pytest.raises(ValueError):
        lengthen(df, None)


def test_lengthen_handles_dotted_names(spark):
    df = spark.createDataFrame([(1, 2.0)], ["id", "Met.19"])
    assert rows(lengthen(df, ["Met.19"])) == [(1, "Met.19", 2.0)]


def test_widen_names_and_missing_cells(spark):
    df = spark.createDataFrame(
        [("y1", 3, 1.0, 10), ("y1", 8, 2.0, 20), ("y2", 3, 3.0, 30), ("y2", 9, 9.0, 90)],
        "year string, line int, p double, n int",
    )
    with pytest.raises(PySparkException, match="not listed"):
        widen(df, ["year"], "line", [3, 8], ["p", "n"]).collect()
    wide = widen(df.where("line <> 9"), ["year"], "line", [3, 8], ["p", "n"])
    assert wide.columns == ["year", "p_3", "p_8", "n_3", "n_8"]
    assert rows(wide) == [("y1", 1.0, 2.0, 10, 20), ("y2", 3.0, None, 30, None)]


def test_widen_refuses_repeated_cells(spark):
    df = spark.createDataFrame([("y", 3, 1.0), ("y", 3, 2.0)], "year string, line int, p double")
    with pytest.raises(PySparkException, match="several rows for one cell"):
        widen(df, ["year"], "line", [3], ["p"]).collect()


def test_share_of_total(spark):
    df = spark.createDataFrame(
        [("y1", "SS", 3), ("y1", "TA", 4), ("y2", "SS", 1), ("y3", "SS", 1), ("y3", "TA", 0)],
        "year string, cat string, n int",
    )
    assert rows(share_of_total(df, ["year"], "cat", "SS", "TA", "n")) == [
        ("y1", 3, 4, 0.75), ("y2", 1, None, None), ("y3", 1, 0, None),
    ]


def test_stack_and_append(spark):
    a = spark.createDataFrame([(1, "x")], "id int, only_a string")
    b = spark.createDataFrame([(2.5, 2)], "only_b double, ID int")
    assert rows(stack([empty_like(a), a, None, b]), "id", "only_a", "only_b") == [
        (1, "x", None), (2, None, 2.5),
    ]
    with pytest.raises(ValueError):
        stack([None])
    base = spark.createDataFrame([("2016", 0.5, "State")], "Year string, Value double, Geo string")
    pool = spark.createDataFrame([("2016", 0.25, "Pool", 9)], "y string, r double, d string, n int")
    out = append_series(base, pool, {"Year": "y", "Value": "r", "Geo": "d"})
    assert rows(out) == [("2016", 0.25, "Pool"), ("2016", 0.5, "State")]


VALUES = [("b", 1.0), ("b", 3.0), ("a", 2.0), ("c", None), ("d", 0.5), ("d", None), (None, 0.0)]


def test_level_order_by_median(spark):
    df = spark.createDataFrame(VALUES, "k string, v double")
    assert [tuple(r) for r in level_order(df, "k", "v").orderBy("level").collect()] == [
        ("d", 0.5, 1), ("a", 2.0, 2), ("b", 2.0, 3), ("c", None, 4), (None, 0.0, 5),
    ]


def test_level_order_by_mean(spark):
    df = spark.createDataFrame([*VALUES, ("a", 4.0)], "k string, v double")
    assert [tuple(r) for r in level_order(df, "k", "v", "mean").orderBy("level").collect()] == [
        ("d", 0.5, 1), ("b", 2.0, 2), ("a", 3.0, 3), ("c", None, 4), (None, 0.0, 5),
    ]
    with pytest.raises(ValueError):
        level_order(df, "k", "v", "mode")


def test_rows_get_their_level(spark):
    df = spark.createDataFrame(VALUES, "k string, v double")
    out = with_levels(df, "k", "v")
    assert out.count() == len(VALUES)
    assert {r.k: r.level for r in out.collect()} == {"d": 1, "a": 2, "b": 3, "c": 4, None: 5}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["a", "b", None]),
            st.one_of(
                st.none(),
                st.floats(),
                st.sampled_from([0.0, -0.0, 1.0, -1.0, 1e-310]),
                st.floats(0.999, 1.001),
            ),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_exact_median_matches_brute_force(spark, items):
    wanted = {}
    for k, v in items:
        kept = wanted.setdefault(k, [])
        if v is not None and not math.isnan(v):
            kept.append(v)

    def median(vs):
        if not vs:
            return None
        low, high = statistics.median_low(vs), statistics.median_high(vs)
        middle = (low + high) / 2
        return "nan" if math.isnan(middle) else middle

    got = exact_median(spark.createDataFrame(items, "k string, v double"), ["k"], "v")
    found = {r.k: "nan" if r.median is not None and math.isnan(r.median) else r.median for r in got.collect()}
    assert found == {k: median(vs) for k, vs in wanted.items()}


def test_median_of_infinite_values(spark):
    inf = math.inf
    df = spark.createDataFrame(
        [("a", inf), ("a", 1.0), ("a", inf), ("b", -inf), ("b", math.nan), ("b", 2.0), ("b", 3.0)], "k string, v double"
    )
    assert {r.k: r.median for r in exact_median(df, ["k"], "v").collect()} == {"a": inf, "b": 2.0}


def test_median_of_a_hot_group(spark):
    """One label holds nearly all rows, and most of them one value."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 1000 == 0, "cold").otherwise("hot").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id") / 7).alias("v"),
    )
    wanted = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.median for r in exact_median(df, ["k"], "v").collect()} == wanted


def test_group_mean_of_small_and_large_values(spark):
    df = spark.createDataFrame(
        [("a", 0.00001), ("b", 0.00004), ("b", None), ("c", 1e15), ("c", 3e15), ("d", None)], "k string, v double"
    )
    assert {r.k: r.mean for r in group_mean(df, ["k"], "v").collect()} == {"a": 1e-5, "b": 4e-5, "c": 2e15, "d": None}
    assert [r.k for r in level_order(df, "k", "v", "mean").orderBy("level").collect()] == ["a", "b", "c", "d"]


def test_other_orders(spark):
    df = spark.createDataFrame(
        [("11th", 3), ("3rd", 2), ("4th", 9), ("Adult", 1), ("11th", 0), (None, 5)], "k string, i int"
    )
    named = lambda d: [(r.k, r.level) for r in d.orderBy("level").collect()]
    assert named(fixed_order(df, "k", ["3rd", "4th", "11th"])) == [
        ("3rd", 1), ("4th", 2), ("11th", 3), ("Adult", 4), (None, 5),
    ]
    assert named(first_seen_order(df, "k", "i")) == [
        ("11th", 1), ("Adult", 2), ("3rd", 3), (None, 4), ("4th", 5),
    ]
    assert named(alphabetical_order(df, "k")) == [
        ("11th", 1), ("3rd", 2), ("4th", 3), ("Adult", 4), (None, 5),
    ]
