"""The published indicators: source table in, chart rows out.

Every function is lazy and returns the columns of ``CHART_COLUMNS``. ``y`` is the raw value;
``y_visible`` is NULL where the chart's axis limits would hide it. ``level`` orders a
category axis. Sources may spell their columns in CamelCase or snake_case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import (
    academic_year_label,
    bucket_of,
    category_family,
    comma_label,
    group_name,
    if_else,
    is_total_or_blank,
    match_value,
    not_in,
    per_hundred,
    per_thousand,
    percent_label,
    place_name,
    round_half_away,
    strip_separators,
    to_number,
    within_limits,
)
from almanack.operators import (
    Geography,
    at_latest,
    chain_latest,
    codebook_definitions,
    columns_from,
    fixed_order,
    geo_column,
    group_names,
    in_geography,
    lengthen,
    matches_any,
    measure_by_year,
    numbers_in,
    pooled_rate,
    sums_by_name,
    widen,
    with_levels,
)
from almanack.operators import share_of_total as share_table
from almanack.sources import html_cell, html_grid_cell, literal_table, snake

CHART_COLUMNS = ["figure", "series", "x", "y", "y_visible", "label", "facet", "level"]
CODES = ["county_code", "district_code", "school_code", "grade", "test_id", "subgroup_id"]

# Assessment subgroup id -> facet of the by-group chart.
SUBGROUP_FAMILIES = {
    "Disability \nStatus": [128, 99],
    "Economic \nStatus": [31, 111],
    "English \nLanguage \nFluency": [6, 7, 8, 120, 142, 160, 243, 180, 170, 190],
    "Race and \nEthnicity": [75, 76, 74, 77, 78, 79, 80, 144],
    "Ethnicity for \nEconomically \nDisadvantaged": [201, 202, 200, 203, 204, 205, 206, 207],
    "Ethnicity for \nNot \nEconomically \nDisadvantaged": [
        221, 222, 220, 223, 224, 225, 226, 227,
    ],
    "Gender": [3, 4],
    "Migrant": [28, 29],
    "Parent \nEducation": [90, 91, 92, 93, 94, 121],
    "Military \nStatus": [50, 51],
    "Homeless \nStatus": [52, 53],
    "Foster \nStatus": [240, 241],
    "All \nStudents": [1],
}
# Two-digit test year of a wide file -> academic year.
WIDE_TEST_YEARS = {"17": "2016-17", "18": "2017-18", "19": "2018-19"}
# Subgroup ids the first edition leaves out.
UNSHOWN_SUBGROUPS = [190, 212]
# Grade order of the assessment charts.
GRADES = ["3rd", "4th", "5th", "6th", "7th", "8th", "11th"]
# Kindergarten readiness scores by year.
READINESS = [(2012, 23), (2015, 25)]
# Population by age range.
AGE_COUNTS = [
    ("Under 5 years", 32846),
    ("5 to 9 years", 31904),
    ("10 to 14 years", 31906),
    ("15 to 19 years", 30321),
    ("20 to 24 years", 32631),
]


def fields(
    figure: str,
    x: Column | str,
    y: Column,
    series: Column | None = None,
    label: Column | None = None,
    facet: Column | None = None,
    level: Column | None = None,
    limits: tuple[float, float] | None = None,
) -> list[Column]:
    """The columns of a chart row."""
    none = F.lit(None)
    y = y.cast("double")
    return [
        F.lit(figure).alias("figure"),
        (none if series is None else series).cast("string").alias("series"),
        (F.col(x) if isinstance(x, str) else x).cast("string").alias("x"),
        y.alias("y"),
        (y if limits is None else within_limits(y, *limits)).alias("y_visible"),
        (none if label is None else label).cast("string").alias("label"),
        (none if facet is None else facet).cast("string").alias("facet"),
        (none if level is None else level).cast("int").alias("level"),
    ]


def chart(
    df: DataFrame,
    figure: str,
    x: Column | str,
    y: Column,
    series: Column | None = None,
    label: Column | None = None,
    facet: Column | None = None,
    level: Column | None = None,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Rows of one figure in the common shape."""
    return df.select(*fields(figure, x, y, series, label, facet, level, limits))


def label_layer(rows: DataFrame) -> DataFrame:
    """The points a trend chart puts a label on: those of its newest year."""
    return chain_latest(rows, "x")


def _number_text(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


# --- Graduation, dropout, college -------------------------------------------------------


def _cohort(grad: DataFrame) -> tuple[DataFrame, Column]:
    df = snake(grad, CODES)
    whole = (
        F.col("district_code").isNull()
        & (F.col("charter_school") == "All")
        & (F.col("dass") == "All")
    )
    return df, whole


def _rate_trend(
    df: DataFrame,
    geo: Geography,
    figure: str,
    measure: str,
    accuracy: float,
    limits: tuple[float, float] | None,
) -> DataFrame:
    rate = F.col(measure) / 100
    return chart(
        numbers_in(df, [measure]),
        figure,
        "academic_year",
        rate,
        series=geo_column(geo),
        label=percent_label(rate, accuracy),
        limits=limits,
    )


def _rate_by_group(df: DataFrame, figure: str, value: Column, label: Column) -> DataFrame:
    shown = (
        df.withColumn("family", category_family("reporting_category"))
        .withColumn("shown", value)
        .where(F.col("reporting_category") != "TA")
    )
    return chart(
        with_levels(shown, "student_group", "shown"),
        figure,
        "student_group",
        F.col("shown"),
        label=label,
        facet=F.col("family"),
        level=F.col("level"),
    )


def graduation_trend(
    grad: DataFrame,
    geo: Geography,
    accuracy: float = 1,
    limits: tuple[float, float] = (0.75, 0.9),
) -> DataFrame:
    """Accuracy and limits are those of the latest edition; earlier ones differ."""
    df, whole = _cohort(grad)
    df = df.where(in_geography(geo) & whole & (F.col("reporting_category") == "TA"))
    measure = "regular_hs_diploma_graduates_rate"
    return _rate_trend(df, geo, "graduation_trend", measure, accuracy, limits)


def dropout_trend(grad: DataFrame, geo: Geography, accuracy: float = 0.1) -> DataFrame:
    df, whole = _cohort(grad)
    df = df.where(in_geography(geo) & whole & (F.col("reporting_category") == "TA"))
    return _rate_trend(df, geo, "dropout_trend", "dropout_rate", accuracy, (0, 0.15))


def _cohort_by_group(
    grad: DataFrame,
    geo: Geography,
    codebook: DataFrame | None,
    figure: str,
    measure: str,
    rated_only: bool,
) -> DataFrame:
    df, whole = _cohort(grad)
    graduated = "regular_hs_diploma_graduates_rate"
    df = numbers_in(df, list(dict.fromkeys([measure, graduated])))
    rated = F.col(graduated).isNotNull() if rated_only else F.lit(True)
    df = at_latest(
        df, "academic_year", F.col("county_code") == geo.county_code, whole, rated
    )
    if codebook is None:
        df = group_names(df)
    else:
        df = codebook_definitions(df, codebook, "SUSP", "reporting_category")
    rate = F.col(measure) / 100
    return _rate_by_group(df, figure, rate, percent_label(rate, 0.1))


def graduation_by_group(
    grad: DataFrame, geo: Geography, codebook: DataFrame | None = None, rated_only: bool = True
) -> DataFrame:
    """Names come from the codebook, or as in earlier editions from the literal code list.

    The first edition also kept groups without a rate (``rated_only=False``).
    """
    measure = "regular_hs_diploma_graduates_rate"
    return _cohort_by_group(grad, geo, codebook, "graduation_by_group", measure, rated_only)


def dropout_by_group(
    grad: DataFrame, geo: Geography, codebook: DataFrame | None = None, rated_only: bool = True
) -> DataFrame:
    """Same rows as the graduation chart: a group needs a graduation rate to be shown."""
    return _cohort_by_group(grad, geo, codebook, "dropout_by_group", "dropout_rate", rated_only)


def college_going_trend(cgr: DataFrame, geo: Geography) -> DataFrame:
    df = snake(cgr, CODES)
    df = df.where(
        F.col("aggregate_level").isin(geo.state_level, "C")
        & F.col("county_code").isin(geo.county_code, geo.state_code)
        & (F.col("reporting_category") == "TA")
        & (F.col("charter_school") == "All")
        & (F.col("alternative_school_accountability_status") == "All")
        & (F.col("completer_type") == "TA")
    )
    measure = "college_going_rate_total_12_months"
    return _rate_trend(df, geo, "college_going_trend", measure, 0.1, (0.5, 0.7))


# --- Enrollment -------------------------------------------------------------------------


def kindergarten_readiness(spark: SparkSession, geo: Geography) -> DataFrame:
    df = literal_table(spark, READINESS, "academic_year int, score int")
    share = F.col("score") / 100
    return chart(
        df,
        "kindergarten_readiness",
        "academic_year",
        F.col("score"),
        series=F.lit(geo.county_name),
        label=percent_label(share, 1),
    )


def pupil_count(
    upc: DataFrame,
    geo: Geography,
    measure: str,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """One count column of the pupil count table, summed over the county's districts."""
    df = snake(upc, CODES)
    df = df.where(F.col("county_code") == geo.county_code)
    years = measure_by_year(df, measure)
    return chart(
        years,
        f"pupil_count_{measure}",
        "year",
        F.col("value"),
        series=F.lit(geo.county_name),
        label=comma_label("value"),
        limits=limits,
    )


def special_education(pages: DataFrame, geo: Geography, **cell: int | str | None) -> DataFrame:
    """One cell per yearly page; pages(year, html). ``column`` names a place of the table's grid, ``cell`` one as written."""
    text = (html_grid_cell if "column" in cell else html_cell)("html", **cell)
    found = pages.select("year", text.alias("text"))  # looked up once per page
    return chart(
        found.select("year", strip_separators("text").alias("count")),
        "special_education",
        "year",
        F.col("count"),
        series=F.lit(geo.county_name),
        label=comma_label("count"),
        limits=(5000, 10000),
    )


def _enrollment(cenrollment: DataFrame, geo: Geography) -> DataFrame:
    df = numbers_in(snake(cenrollment, CODES), ["cumulative_enrollment"])
    return df.where(
        (F.col("county_code") == geo.county_code)
        & (F.col("aggregate_level") == "C")
        & (F.col("charter") == "All")
    )


def cumulative_enrollment(
    cenrollment: DataFrame,
    geo: Geography,
    category: str,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    df = _enrollment(cenrollment, geo).where(F.col("reporting_category") == category)
    return chart(
        df,
        f"cumulative_enrollment_{category}",
        "academic_year",
        F.col("cumulative_enrollment"),
        series=F.lit(geo.county_name),
        label=comma_label("cumulative_enrollment"),
        limits=limits,
    )


def enrollment_share(
    cenrollment: DataFrame,
    geo: Geography,
    category: str,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    df = share_table(
        _enrollment(cenrollment, geo),
        ["academic_year"],
        "reporting_category",
        category,
        "TA",
        "cumulative_enrollment",
    )
    return chart(
        df,
        f"enrollment_share_{category}",
        "academic_year",
        F.col("share"),
        series=F.lit(geo.county_name),
        label=percent_label("share", 0.1),
        limits=limits,
    )


# --- Suspension and expulsion -----------------------------------------------------------


def _discipline(table: DataFrame, *measures: str) -> DataFrame:
    df = numbers_in(snake(table, CODES), measures)
    return df.where(F.col("district_code").isNull() & is_total_or_blank("charter_yn"))


def suspension_trend(susp: DataFrame, geo: Geography, accuracy: float = 0.1) -> DataFrame:
    """Plotted in percent points, labelled as a percentage."""
    df = _discipline(susp, "suspension_rate_total")
    df = df.where(in_geography(geo) & (F.col("reporting_category") == "TA"))
    rate = F.col("suspension_rate_total")
    return chart(
        df,
        "suspension_trend",
        "academic_year",
        rate,
        series=geo_column(geo),
        label=percent_label(rate / 100, accuracy),
    )


def suspension_by_group(susp: DataFrame, geo: Geography) -> DataFrame:
    df = _discipline(susp, "suspension_rate_total")
    df = at_latest(df, "academic_year", F.col("county_code") == geo.county_code)
    rate = F.col("suspension_rate_total") / 100
    return _rate_by_group(
        group_names(df), "suspension_by_group", rate, percent_label(rate, 0.1)
    )


def _expelled(exp: DataFrame) -> DataFrame:
    """Expulsion rows with their rate per 1,000."""
    part, whole = "unduplicated_count_of_students_expelled_total", "cumulative_enrollment"
    return _discipline(exp, part, whole).withColumn("rate", per_thousand(part, whole))


def expulsion_trend(exp: DataFrame, geo: Geography, percent: bool = False) -> DataFrame:
    """The first edition labels the rate as if it were a percentage."""
    df = _expelled(exp).where(in_geography(geo) & (F.col("reporting_category") == "TA"))
    rate = F.col("rate")
    rounded = round_half_away(rate, 2)
    return chart(
        df,
        "expulsion_trend",
        "academic_year",
        rate,
        series=geo_column(geo),
        label=percent_label(rounded / 100, 0.01) if percent else _number_text(rounded),
    )


def expulsion_by_group(exp: DataFrame, geo: Geography) -> DataFrame:
    df = at_latest(_expelled(exp), "academic_year", F.col("county_code") == geo.county_code)
    rate = F.col("rate")
    return _rate_by_group(
        group_names(df), "expulsion_by_group", rate, _number_text(round_half_away(rate, 2))
    )


def suspension_burden(
    files: DataFrame,
    category: str,
    district: str | None = None,
    year: str | None = None,
    floor: float | None = None,
    school_totals: bool = True,
) -> DataFrame:
    """Suspensions per 100 students, highest first, among the non-charter rows.

    The sort carries the identifying columns behind the rate, so many equal rates still
    spread over several range partitions.
    """
    df = snake(files, CODES)
    people = to_number("cumulative_enrollment")
    keep = (F.col("reporting_category") == category) & F.trim("charter_yn").isin("N", "No")
    if school_totals:
        keep = keep & ((F.col("school_code") == "0") | F.col("school_code").isNull())
    if district is not None:
        keep = keep & (F.col("district_code") == district)
    if year is not None:
        keep = keep & (F.col("academic_year") == year)
    if floor is not None:
        keep = keep & (people >= floor)
    keys = ["academic_year", "district_code", "district_name", "school_code"]
    burden = per_hundred(to_number("total_suspensions"), people).alias("burden")
    return (
        df.where(keep)
        .select(*keys, "total_suspensions", "cumulative_enrollment", burden)
        .orderBy(F.col("burden").desc_nulls_last(), *keys)
    )


def district_pool(
    files: DataFrame, geo: Geography, districts: Sequence[str], name: str
) -> DataFrame:
    """academic_year, rate and Geo of several districts taken together."""
    df = snake(files, CODES)
    df = df.where(
        F.col("aggregate_level").isin("D1", "D2")
        & (F.col("county_code") == geo.county_code)
        & matches_any("district_name", districts)
        & (F.col("reporting_category") == "TA")
    )
    part = "unduplicated_count_of_students_suspended_total"
    df = numbers_in(df, ["cumulative_enrollment", part])
    pooled = pooled_rate(df, ["academic_year", "county_code"], part, "cumulative_enrollment")
    return pooled.withColumn("geo", F.lit(name))


def discipline_frame(
    files: DataFrame,
    geo: Geography,
    measures: Sequence[str],
    either: tuple[str, str] | None = None,
) -> DataFrame:
    """State and county totals from yearly files, with numeric measures.

    ``either`` names a measure and the one that replaced it in later files; the second is
    used where present and the first otherwise, as ``<second>2``.
    """
    df = snake(files, CODES).where(
        in_geography(geo)
        & F.col("district_code").isNull()
        & (F.col("reporting_category") == "TA")
    )
    df = numbers_in(df.withColumn("geo", geo_column(geo)), [*measures, *(either or ())])
    if either is not None:
        old, new = either
        df = df.withColumn(f"{new}2", F.coalesce(new, old))
    return df


# --- Fitness ----------------------------------------------------------------------------


def fitness_by_grade(pft: DataFrame, geo: Geography) -> DataFrame:
    """Share of students meeting four of six tests, per grade; year is a column of pft."""
    county = int(geo.county_code)
    df = snake(pft).where(
        F.col("co").isin(0, county)
        & F.col("level_number").isin(3, 4)
        & (F.col("report_number") == 0)
        & (F.col("table_number") == 2)
        & F.col("line_number").isin(3, 8)
    )
    measures = ["no_stud5", "perc5b", "no_stud7", "perc7b", "no_stud9", "perc9b"]
    wide = widen(df, ["year", "co"], "line_number", [3, 8], measures)
    wide = wide.drop("no_stud5_3", "no_stud7_3", "no_stud9_3", "perc5b_8", "perc7b_8", "perc9b_8")
    long = lengthen(wide, None, ["year", "co"])
    grade = match_value(
        "name",
        {
            "perc5b_3": "5",
            "perc7b_3": "7",
            "perc9b_3": "9",
            "no_stud5_8": "5",
            "no_stud7_8": "7",
            "no_stud9_8": "9",
        },
    )
    place = if_else(F.col("co") == 0, geo.state_name, geo.county_name.removesuffix(" County"))
    share = F.col("value") / 100
    return chart(
        long.where(F.col("name").rlike("perc")),
        "fitness_by_grade",
        "year",
        share,
        series=F.concat(place, F.lit(" "), grade),
        label=percent_label(share, 1),
        limits=(0.5, 0.8),
    )


# --- Assessments ------------------------------------------------------------------------


def _assessed(caaspp: DataFrame, geo: Geography, codebook: DataFrame | None) -> DataFrame:
    df = snake(caaspp, CODES).withColumnRenamed("percentage_standard_met_and_above", "met")
    df = numbers_in(df, ["met"]).where(
        F.col("county_code").isin(geo.state_code, geo.county_code)
        & (F.col("district_code") == "00000")
        & (F.col("grade") == "13")
    )
    df = df.withColumn(
        "geo",
        if_else(F.col("county_code") == geo.state_code, geo.state_name, geo.county_name),
    )
    if codebook is None:
        return df
    family = {name: [str(i) for i in ids] for name, ids in SUBGROUP_FAMILIES.items()}
    df = codebook_definitions(df, codebook, "CAASPP", "subgroup_id")
    return df.withColumn("family", bucket_of("subgroup_id", family))


def _test_name(test_id: int) -> str:
    return "ela" if test_id == 1 else "math"


def assessment_trend(
    caaspp: DataFrame, geo: Geography, test_id: int, accuracy: float = 0.1
) -> DataFrame:
    df = _assessed(caaspp, geo, None).where(
        (F.col("test_id") == str(test_id)) & (F.col("subgroup_id") == "1")
    )
    share = F.col("met") / 100
    return chart(
        df,
        f"{_test_name(test_id)}_trend",
        "test_year",
        share,
        series=F.col("geo"),
        label=percent_label(share, accuracy),
        limits=(0, 0.6),
    )


def assessment_by_group(
    caaspp: DataFrame, geo: Geography, codebook: DataFrame, test_id: int
) -> DataFrame:
    """Newest year of the county; placeholder groups and crossed ethnicity facets left out.

    A group or facet that is not in the code lists is NULL and drops out as well.
    """
    df = at_latest(
        _assessed(caaspp, geo, codebook),
        "test_year",
        F.col("test_id") == str(test_id),
        F.col("county_code") == geo.county_code,
        ~F.col("student_group").rlike("TBD"),
        ~F.col("family").rlike("Ethnicity for"),
    )
    share = F.col("met") / 100
    return chart(
        with_levels(df, "student_group", "met"),
        f"{_test_name(test_id)}_by_group",
        "student_group",
        share,
        label=percent_label(share, 0.1),
        facet=F.col("family"),
        level=F.col("level"),
    )


def years_from_suffix(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rename measure.19 and the like to the academic year; other suffixes stay as they are.

    The names are known when the plan is made, so no text is worked on per row.
    """
    years = {c: c.rsplit(".", 1)[-1] for c in columns}
    years = {c: WIDE_TEST_YEARS.get(y, y) for c, y in years.items()}
    return df.withColumnsRenamed(years), list(years.values())


def assessment_long(wide: DataFrame, geo: Geography) -> DataFrame:
    """Long form of the older wide file, one column per year with a two-digit suffix."""
    met = columns_from(wide, "Percentage Standard Met and")
    ids = {
        "Subgroup ID": "subgroup_id",
        "Student Group": "student_group",
        "Demographic Name": "demographic_name",
        "County Code": "county_code",
        "TestID": "test",
    }
    df = numbers_in(
        wide.where(
            F.col("County Code").isin(geo.state_code, geo.county_code)
            & (F.col("District Code") == "00000")
            & (F.col("Grade") == "Overall")
        ).select(*[F.col(f"`{c}`") for c in [*ids, *met]]),
        met,
    )
    df, years = years_from_suffix(df.withColumnsRenamed(ids), met)
    return lengthen(df, years, name="year").withColumn(
        "geo",
        if_else(F.col("county_code") == geo.state_code, geo.state_name, geo.county_name),
    )


def assessment_wide_trend(wide: DataFrame, geo: Geography, test: str) -> DataFrame:
    df = assessment_long(wide, geo).where(
        (F.col("test") == test) & (F.col("subgroup_id").cast("string") == "1")
    )
    share = F.col("value") / 100
    return chart(
        df,
        f"{test.lower()}_wide_trend",
        "year",
        share,
        series=F.col("geo"),
        label=percent_label(share, 1),
        limits=(0, 0.6),
    )


def assessment_wide_by_group(wide: DataFrame, geo: Geography, test: str) -> DataFrame:
    number = F.col("subgroup_id").cast("string").try_cast("int")
    df = at_latest(
        assessment_long(wide, geo),
        "year",
        F.col("test") == test,
        F.col("county_code") == geo.county_code,
        (number < 200) & not_in(number, UNSHOWN_SUBGROUPS),
    )
    share = F.col("value") / 100
    return chart(
        with_levels(df, "demographic_name", "value"),
        f"{test.lower()}_wide_by_group",
        "demographic_name",
        share,
        label=percent_label(share, 0.1),
        facet=F.col("student_group"),
        level=F.col("level"),
    )


# --- English learners -------------------------------------------------------------------


def _learner_chart(sums: DataFrame, figure: str, year: str) -> DataFrame:
    return chart(
        sums,
        figure,
        year,
        F.col("value"),
        series=F.col("name"),
        label=comma_label("value"),
        limits=(0, 35000),
    )


def reclassification(reclass: DataFrame, geo: Geography, source: str = "table") -> DataFrame:
    """Reclassified students and English learners per year.

    The table names the county and holds a year text; the file form has district codes
    starting with the county code, and the year comes from the file name.
    """
    df = snake(reclass)
    if source == "table":
        df = df.where(F.col("county") == geo.county_name.removesuffix(" County"))
    else:
        df = df.where(F.col("cds").startswith(geo.county_code))
    df = numbers_in(df.withColumn("year", academic_year_label("year")), ["reclass", "el"])
    sums = sums_by_name(df, "year", {"Reclassified Students": "reclass", "EL Enrollment": "el"})
    return _learner_chart(sums, "reclassification", "year")


def language_status(elas: DataFrame, geo: Geography) -> DataFrame:
    df = snake(elas).where(
        (F.col("county_name") == geo.county_name.removesuffix(" County"))
        & F.col("district_name").isNull()
        & (F.col("gender") == "ALL")
    )
    sums = sums_by_name(
        numbers_in(df, ["rfep", "el"]),
        "academic_year",
        {"Reclassified Students": "rfep", "EL Enrollment": "el"},
    )
    return _learner_chart(sums, "language_status", "academic_year")


# --- Charts of the earlier report, from workbook sheets ---------------------------------


def sheet_by_group(
    sheet: DataFrame,
    figure: str,
    focus: str,
    group: str = "group",
    value: str = "value",
    percent: bool = True,
) -> DataFrame:
    """Bars by group and geography, groups ordered by their mean value."""
    df = snake(sheet).withColumns(
        {"geo": place_name("geo", focus), group: group_name(group)}
    )
    number = F.col(value)
    return chart(
        with_levels(df, group, value, "mean"),
        figure,
        group,
        number,
        series=F.col("geo"),
        label=percent_label(number, 1) if percent else _number_text(number.cast("double")),
        level=F.col("level"),
    )


def personnel(sheet: DataFrame) -> DataFrame:
    """Students per support staff member; one staff group is left out."""
    df = snake(sheet).where(F.col("group") != "Social Worker")
    return chart(
        with_levels(df, "group", "value", "mean"),
        "personnel",
        "group",
        F.col("value"),
        series=F.col("geo"),
        label=_number_text(F.col("value").cast("double")),
        level=F.col("level"),
    )


def sheet_trend(
    sheet: DataFrame,
    figure: str,
    measure: str,
    accuracy: float,
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Lines by geography from a sheet that already holds fractions."""
    rate = F.col(measure)
    return chart(
        snake(sheet),
        figure,
        "year",
        rate,
        series=F.col("geo"),
        label=percent_label(rate, accuracy),
        limits=limits,
    )


def assessment_sheet(sheet: DataFrame, focus: str) -> DataFrame:
    """Long form of the assessment sheet: Test, Geo, Group, Subgroup, Year, value."""
    df = sheet.withColumns({"Geo": place_name("Geo", focus), "Subgroup": group_name("Subgroup")})
    return lengthen(df, None, ["Test", "Geo", "Group", "Subgroup"], name="Year")


def assessment_sheet_by_group(
    sheet: DataFrame, focus: str, test: str, year: str
) -> DataFrame:
    df = assessment_sheet(sheet, focus).where(
        (F.col("Test") == test) & (F.col("Group") == "Subgroup") & (F.col("Year") == year)
    )
    return chart(
        with_levels(df, "Subgroup", "value", "mean"),
        f"{test.lower()}_sheet_by_group",
        "Subgroup",
        F.col("value"),
        series=F.col("Geo"),
        label=percent_label("value", 1),
        level=F.col("level"),
    )


def assessment_sheet_by_grade(
    sheet: DataFrame,
    focus: str,
    test: str,
    place: str,
    limits: tuple[float, float],
    front: Sequence[str] = GRADES,
) -> DataFrame:
    """One line per grade; grades keep their school order."""
    df = assessment_sheet(sheet, focus).where(
        (F.col("Test") == test) & (F.col("Group") == "Grade") & (F.col("Geo") == place)
    )
    order = fixed_order(df, "Subgroup", front)
    return chart(
        df.join(order, "Subgroup", "left"),
        f"{test.lower()}_sheet_by_grade",
        "Year",
        F.col("value"),
        series=F.col("Subgroup"),
        level=F.col("level"),
        limits=limits,
    )


def assessment_table(sheet: DataFrame, years: Sequence[str], test: str) -> DataFrame:
    """Subgroup by year as percent texts."""
    df = sheet.where((F.col("Test") == test) & (F.col("Group") == "Subgroup"))
    return df.select("Subgroup", *[percent_label(F.col(f"`{y}`"), 1).alias(y) for y in years])


def age_table(spark: SparkSession) -> DataFrame:
    """Population by age range with display counts."""
    df = literal_table(spark, AGE_COUNTS, "age_range string, people int")
    return df.select("age_range", comma_label("people").alias("count"))


def fraction_of(parts: Sequence[float], others: Sequence[float] = (), whole: float | None = None) -> Column:
    """A narrative number: parts over parts and others, or over a given whole."""
    top = float(sum(parts))
    bottom = float(whole) if whole is not None else top + float(sum(others))
    return F.try_divide(F.lit(top), F.lit(bottom))
