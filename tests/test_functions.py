import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanack.functions import (
    academic_year_label,
    bucket_of,
    category_family,
    comma_label,
    first_letter,
    first_number,
    group_name,
    if_else,
    is_total_or_blank,
    mask_year,
    match_value,
    not_in,
    per_hundred,
    per_thousand,
    percent_label,
    place_name,
    recode,
    round_half_away,
    share,
    strict_max,
    strict_sum,
    strip_separators,
    title_case,
    to_number,
    within_limits,
)
from almanack.plans.indicators import fraction_of


def values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in df.select(expr).collect()]


def texts(spark, items, expr):
    return values(spark, [(x,) for x in items], "x string", expr)


def doubles(spark, items, expr):
    return values(spark, [(x,) for x in items], "x double", expr)


def test_suppressed_and_malformed_text_is_null(spark):
    items = ["12", " 12.5 ", "*", "1,234", "", None, "NA", "1d", "2f", "-3", "1e3", ".5", "D1", "NaN"]
    assert texts(spark, items, to_number("x")) == [
        12.0, 12.5, None, None, None, None, None, None, None, -3.0, 1000.0, 0.5, None, None,
    ]


def test_strip_separators(spark):
    assert texts(spark, ["9,876", "1,234,567", "12", "*"], strip_separators("x")) == [
        9876.0, 1234567.0, 12.0, None,
    ]


def test_rates_are_null_on_zero_denominator(spark):
    rows = [(1.0, 4.0), (1.0, 0.0), (None, 4.0), (1.0, None)]
    for f, k in ((per_hundred, 100), (per_thousand, 1000), (share, 1)):
        assert values(spark, rows, "n double, d double", f("n", "d")) == [0.25 * k, None, None, None]


def test_unknown_condition_gives_null(spark):
    choice = if_else(F.col("x") == "T", "state", "county")
    assert texts(spark, ["T", "C", None], choice) == ["state", "county", None]


def test_not_in_keeps_null(spark):
    assert texts(spark, ["a", "b", None], not_in("x", ["a"])) == [False, True, True]


def test_total_or_blank(spark):
    assert texts(spark, ["All", "", None, "N"], is_total_or_blank("x")) == [True, True, True, False]


def test_match_recode_bucket(spark):
    items = ["a", "z", None]
    assert texts(spark, items, match_value("x", {"a": "A"})) == ["A", None, None]
    assert texts(spark, items, recode("x", {"a": "A"})) == ["A", "z", None]
    assert texts(spark, items, bucket_of("x", {"one": ["b"], "two": ["a", "b"]})) == ["two", None, None]
    assert texts(spark, items, match_value("x", {})) == [None, None, None]


def test_mask_year(spark):
    rows = [(1.0, "2017-18"), (2.0, "2018-19")]
    assert values(spark, rows, "x double, y string", mask_year("x", "y", "2018-19")) == [1.0, None]


def test_first_letter_and_family(spark):
    items = ["RB", "1GM", "TA", "12", "", "éa", None]
    assert texts(spark, items, first_letter("x")) == ["R", "G", "T", None, None, "é", None]
    assert texts(spark, items, category_family("x")) == [
        "Race/Ethnicity", "Gender", None, None, None, None, None,
    ]


def test_academic_year_label(spark):
    items = ["reclass19.txt", "10", "year 9", "none", None]
    assert texts(spark, items, academic_year_label("x")) == [
        "2018-2019", "2009-2010", "2008-2009", None, None,
    ]


def test_ambiguous_year_fails(spark):
    with pytest.raises(PySparkException, match="more than one number"):
        texts(spark, ["2019"], first_number("x"))


def test_round_half_away(spark):
    items = [0.285, 0.5, -0.5, 2.5, -2.345, 1e300, None]
    assert doubles(spark, items, round_half_away("x", 2)) == [
        0.28, 0.5, -0.5, 2.5, -2.35 if math.floor(234.5 + 0.5) == 235 else None, 1e300, None,
    ]
    assert doubles(spark, [0.5, 1.5, -2.5], round_half_away("x")) == [1.0, 2.0, -3.0]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=50), st.integers(0, 3))
def test_round_half_away_matches_definition(spark, items, digits):
    def wanted(x):
        z = math.trunc(abs(x) * 10**digits + 0.5) / 10**digits
        return z * math.copysign(1, x) if x else 0.0

    assert doubles(spark, items, round_half_away("x", digits)) == [wanted(x) for x in items]


def test_percent_label_ties_go_to_even(spark):
    items = [0.1225, 0.285, -0.0005, 0.125, 1.0, 0.0, 12.5, None]
    assert doubles(spark, items, percent_label("x", 0.1)) == [
        "12.2%", "28.5%", "0.0%", "12.5%", "100.0%", "0.0%", "1250.0%", None,
    ]
    assert doubles(spark, items, percent_label("x", 1)) == [
        "12%", "28%", "0%", "12%", "100%", "0%", "1250%", None,
    ]
    assert doubles(spark, [0.00329, -0.285678], percent_label("x", 0.01)) == ["0.33%", "-28.57%"]


def test_comma_label(spark):
    assert doubles(spark, [1234567.5, 2.5, 999.0, None], comma_label("x")) == [
        "1,234,568", "2", "999", None,
    ]


def test_title_case(spark):
    items = ["dis-abilities", "(el)", "don't stop", "3rd", "MIDDLE EAST", "", None]
    assert texts(spark, items, title_case("x")) == [
        "Dis-Abilities", "(El)", "Don't Stop", "3rd", "Middle East", "", None,
    ]


def test_place_and_group_names(spark):
    items = ["springfield", "SPRINGFIELD COUNTY", "california", None]
    assert texts(spark, items, place_name("x", "Springfield")) == [
        "Springfield County", "Springfield County", "California", None,
    ]
    items = ["english only (eo)", "el", "elementary", "eon el"]
    assert texts(spark, items, group_name("x")) == ["English Only (EO)", "ELs", "Elementary", "Eon ELs"]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, v int")
    got = df.groupBy("k").agg(strict_sum("v").alias("s"), strict_max("v").alias("m")).collect()
    assert sorted(map(tuple, got)) == [("a", None, None), ("b", 5, 3)]


def test_within_limits(spark):
    assert doubles(spark, [0.74, 0.75, 0.9, 0.91, None], within_limits("x", 0.75, 0.9)) == [
        None, 0.75, 0.9, None, None,
    ]


@pytest.mark.parametrize(
    ("parts", "others", "whole", "value"),
    [
        ([2785, 4058], [17910, 15266], None, 0.170994),
        ([12769, 12317], [], 16836 + 16010, 0.763746),
        ([4221, 11148, 4072, 10230], [], 6476 + 4330 + 3162 + 9749 + 6192 + 3525 + 3100 + 8765, 0.655003),
        ([8882], [], 77954, 0.113939),
        ([87893], [], 6220413, 0.014130),
    ],
)
def test_narrative_numbers(spark, parts, others, whole, value):
    got = spark.range(1).select(fraction_of(parts, others, whole)).first()[0]
    assert got == pytest.approx(value, abs=5e-7)


def test_percent_labels_of_other_accuracies(spark):
    df = spark.createDataFrame([(0.1274,), (-0.0051,), (math.inf,), (None,)], "v double")
    labels = [r[0] for r in df.select(percent_label("v", 0.5)).collect()]
    assert labels == ["12.5%", "-0.5%", None, None]
