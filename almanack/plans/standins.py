"""Source tables in their published shapes, derived from the panel.

The published files are not available here, so each indicator is checked on a stand-in
with the same columns, types and conventions: drifting names, text measures, suppressed
cells, sentinel totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import match_value
from almanack.operators.reshape import found_names, widen
from almanack.sources import STUDENT_GROUPS, literal_table

YEARS = ["1995-96", "1996-97", "1997-98", "1998-99", "1999-00", "2000-01", "2001-02"]
# Cells on fewer people than this are suppressed.
SUPPRESS_BELOW = 11

def _people() -> Column:
    return F.col("cumulative_enrollment")


def _start_year() -> Column:
    return F.substring("academic_year", 1, 4).cast("int")


def _rounded_down(top: Column) -> Column:
    """Percent text with two decimals from a count of hundredths, "*" when suppressed."""
    cents = ((top - top % _people()) / _people()).cast("bigint")
    text = F.concat(
        ((cents - cents % 100) / 100).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )
    return F.when(_people() < SUPPRESS_BELOW, "*").otherwise(text)


def codebook(spark: SparkSession) -> DataFrame:
    """table, value, definition; the category RA is missing on purpose."""
    rows = [("SUSP", code, name) for code, name in STUDENT_GROUPS if code != "RA"]
    rows += [
        ("CAASPP", "1", "All Students"),
        ("CAASPP", "3", "Female"),
        ("CAASPP", "4", "Male"),
        ("CAASPP", "52", "TBD"),
        ("CAASPP", "74", "Black"),
        ("CAASPP", "204", "Asian, disadvantaged"),
    ]
    return literal_table(spark, rows, "table string, value string, definition string")


def grad_four(panel: DataFrame) -> DataFrame:
    enough = _people() >= SUPPRESS_BELOW
    return panel.select(
        "academic_year",
        "aggregate_level",
        "county_code",
        "county_name",
        "district_code",
        "reporting_category",
        F.col("charter").alias("charter_school"),
        F.lit("All").alias("dass"),
        F.when(enough, (_people() * 100 - F.col("affected") * 50) / _people()).alias(
            "regular_hs_diploma_graduates_rate"
        ),
        F.when(enough, F.col("pending") * 30 / _people()).alias("dropout_rate"),
    )


def cgr(panel: DataFrame) -> DataFrame:
    return panel.select(
        F.col("academic_year").alias("AcademicYear"),
        F.col("aggregate_level").alias("AggregateLevel"),
        F.col("county_code").alias("CountyCode"),
        F.col("county_name").alias("CountyName"),
        F.col("reporting_category").alias("ReportingCategory"),
        F.col("charter").alias("CharterSchool"),
        F.lit("All").alias("AlternativeSchoolAccountabilityStatus"),
        F.lit("TA").alias("CompleterType"),
        _rounded_down(_people() * 4000 + F.col("affected") * 6000).alias(
            "College_Going_Rate_Total_12_Months"
        ),
    )


def cenrollment(panel: DataFrame) -> DataFrame:
    return panel.withColumn("cumulative_enrollment", _people().cast("string"))


def _drifting_charter() -> Column:
    """Early years leave the total's charter column empty in two ways."""
    return (
        F.when(F.col("charter") != "All", F.col("charter"))
        .when(_start_year() < 1997, None)
        .when(_start_year() == 1997, "")
        .otherwise("All")
    )


def susp(panel: DataFrame) -> DataFrame:
    return panel.select(
        "academic_year",
        "aggregate_level",
        "county_code",
        "county_name",
        "district_code",
        "reporting_category",
        _drifting_charter().alias("charter_yn"),
        (F.col("affected") * 10 / _people()).alias("suspension_rate_total"),
    )


def exp(panel: DataFrame) -> DataFrame:
    return panel.select(
        "academic_year",
        "aggregate_level",
        "county_code",
        "county_name",
        "district_code",
        "reporting_category",
        _drifting_charter().alias("charter_yn"),
        F.col("pending").alias("unduplicated_count_of_students_expelled_total"),
        "cumulative_enrollment",
    )


def reclass(panel: DataFrame) -> DataFrame:
    return panel.where(
        F.col("district_code").isNotNull()
        & (F.col("reporting_category") == "TA")
        & (F.col("charter") == "All")
    ).select(
        F.col("county_name").alias("County"),
        F.concat(F.col("county_code"), F.col("district_code")).alias("CDS"),
        F.concat(F.lit("reclass"), (_start_year() - 1980).cast("string"), F.lit(".txt")).alias(
            "YEAR"
        ),
        F.col("affected").alias("Reclass"),
        _people().alias("EL"),
    )


def elas(panel: DataFrame) -> DataFrame:
    gender = match_value("reporting_category", {"TA": "ALL", "GF": "F", "GM": "M"})
    return panel.where((F.col("charter") != "All") & gender.isNotNull()).select(
        F.col("academic_year").alias("AcademicYear"),
        F.col("county_name").alias("CountyName"),
        F.col("district_name").alias("DistrictName"),
        gender.alias("Gender"),
        F.col("affected").alias("RFEP"),
        F.col("pending").alias("EL"),
    )


def upc(panel: DataFrame) -> DataFrame:
    categories = ["TA", "SH", "RB", "RA"]
    districts = panel.where(
        F.col("district_code").isNotNull()
        & (F.col("charter") == "All")
        & F.col("reporting_category").isin(categories)
    )
    wide = widen(
        districts,
        ["academic_year", "county_code", "district_code"],
        "reporting_category",
        categories,
        ["cumulative_enrollment"],
    )
    return wide.select(
        "academic_year",
        F.col("county_code").cast("int").alias("County_Code"),
        F.col("cumulative_enrollment_TA").alias("total_enrollment"),
        F.col("cumulative_enrollment_SH").alias("homeless"),
        F.col("cumulative_enrollment_RB").alias("unduplicated_frpm_eligible_count"),
        F.col("cumulative_enrollment_RA").alias("english_learner_el"),
    )


def pft(panel: DataFrame) -> DataFrame:
    groups = ["RB", "RA", "GF"]
    wide = widen(
        panel.where(F.col("reporting_category").isin(groups)).withColumn(
            "kept", (_people() - F.col("affected")) * 100 / _people()
        ),
        ["academic_year", "county_code", "aggregate_level", "district_code", "charter"],
        "reporting_category",
        groups,
        ["cumulative_enrollment", "kept"],
    )
    line = F.col("Line_Number")
    counts = [
        F.when(line == 8, F.col(f"cumulative_enrollment_{g}"))
        .otherwise(F.col(f"cumulative_enrollment_{g}") * 2)
        .cast("double")
        .alias(f"NoStud{grade}")
        for g, grade in zip(groups, (5, 7, 9), strict=True)
    ]
    percents = [
        F.when(line == 3, F.col(f"kept_{g}")).otherwise(F.col(f"kept_{g}") / 2).alias(f"Perc{grade}b")
        for g, grade in zip(groups, (5, 7, 9), strict=True)
    ]
    return wide.withColumn("Line_Number", F.explode(F.array(F.lit(3), F.lit(8)))).select(
        F.col("academic_year").alias("year"),
        F.col("county_code").cast("int").alias("CO"),
        match_value("aggregate_level", {"T": 4, "C": 3}).alias("Level_Number"),
        F.lit(0).alias("Report_Number"),
        F.when(F.col("charter") == "All", 2).otherwise(1).alias("Table_Number"),
        "Line_Number",
        *counts,
        *percents,
    )


def sped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, html: each page with a table whose cell in row 22, column 15 of the grid is the page's length.

    Cells span rows and columns, so the cell is the twelfth that its row writes.
    """
    head = "<tr>" + "".join(f"<th>c{i}</th>" for i in range(1, 17)) + "</tr>"
    body = "".join(f"<tr><td>{i}</td><td colspan='15'>{i * 100}</td></tr>" for i in range(1, 21))
    last = "<tr><td colspan=3 rowspan='2'>Total</td>" + "".join(f"<td>{i}</td>" for i in range(13)) + "</tr><tr>" + "<td>0</td>" * 11 + "<td align=right><b>"
    table = F.concat(
        F.lit(f"<table border=1>{head}{body}{last}"), F.format_number(F.length("html"), 0), F.lit("</b>&nbsp;</td><td>1</td></tr></table>")
    )
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").alias("year"), F.concat("html", table).alias("html"))


SUBGROUP_IDS = {"TA": 1, "RB": 74, "RA": 204, "GF": 3, "GM": 4, "SH": 52}


def caaspp(panel: DataFrame) -> DataFrame:
    tested = panel.withColumn("Test_Id", F.explode(F.array(F.lit(1), F.lit(2))))
    met = F.when(F.col("Test_Id") == 1, F.col("affected")).otherwise(F.col("pending"))
    return tested.select(
        F.col("county_code").alias("County_Code"),
        F.coalesce("district_code", F.lit("00000")).alias("District_Code"),
        F.when(F.col("charter") == "All", 13).otherwise(11).alias("Grade"),
        "Test_Id",
        _start_year().alias("Test_Year"),
        match_value("reporting_category", SUBGROUP_IDS).alias("Subgroup_ID"),
        _rounded_down(met * 10000).alias("Percentage_Standard_Met_and_Above"),
    )


def caaspp_wide(panel: DataFrame) -> DataFrame:
    """One column per test year, named by the last two digits of a shifted year."""
    tested = (
        panel.where(F.col("aggregate_level").isin("T", "C"))
        .withColumn("test", F.explode(F.array(F.lit("ELA"), F.lit("Math"))))
        .withColumn("start", _start_year())
        .withColumn(
            "met",
            F.when(F.col("test") == "ELA", F.col("affected")).otherwise(F.col("pending"))
            * 100
            / _people(),
        )
    )
    years = found_names(tested, "start")
    wide = widen(
        tested, ["county_code", "charter", "reporting_category", "test"], "start", years, ["met"]
    )
    return wide.select(
        match_value("reporting_category", SUBGROUP_IDS).alias("Subgroup ID"),
        F.substring("reporting_category", 1, 1).alias("Student Group"),
        F.concat(F.lit("Group "), F.col("reporting_category")).alias("Demographic Name"),
        F.col("county_code").alias("County Code"),
        F.lit("00000").alias("District Code"),
        F.when(F.col("charter") == "All", "Overall").otherwise("11").alias("Grade"),
        F.col("test").alias("TestID"),
        *[
            F.col(f"met_{y}").alias(f"Percentage Standard Met and Above.{y - 1982}")
            for y in reversed(years)
        ],
    )


def susp_files(panel: DataFrame) -> list[DataFrame]:
    """Two generations of yearly suspension files: other names, other column order."""
    number = lambda c: F.when(_people() < SUPPRESS_BELOW, "*").otherwise(F.col(c).cast("string"))
    early = _start_year() < 1999
    school = F.when(F.col("aggregate_level") == "D1", "0")
    first = panel.where(early).select(
        F.col("academic_year").alias("Academic Year"),
        F.col("aggregate_level").alias("Aggregate Level"),
        F.col("county_code").alias("County Code"),
        F.col("county_name").alias("County Name"),
        F.col("district_code").alias("District Code"),
        F.col("district_name").alias("District Name"),
        school.alias("School Code"),
        F.col("charter").alias("CharterYN"),
        F.col("reporting_category").alias("Reporting Category"),
        _people().cast("string").alias("Cumulative Enrollment"),
        number("affected").alias("Total Suspensions"),
        number("pending").alias("Unduplicated Count of Students Suspended (Total)"),
        number("affected").alias("Suspension Count Defiance Only"),
    )
    second = panel.where(~early).select(
        F.col("academic_year").alias("AcademicYear"),
        F.when(F.col("charter") == "N", "No ").otherwise(F.col("charter")).alias("CharterYn"),
        F.col("aggregate_level").alias("AggregateLevel"),
        F.col("county_code").alias("CountyCode"),
        F.col("county_name").alias("CountyName"),
        F.col("district_code").alias("DistrictCode"),
        F.col("district_name").alias("DistrictName"),
        school.alias("SchoolCode"),
        F.col("reporting_category").alias("ReportingCategory"),
        number("pending").alias("UnduplicatedCountOfStudentsSuspendedTotal"),
        number("affected").alias("TotalSuspensions"),
        _people().cast("string").alias("CumulativeEnrollment"),
        number("pending").alias("SuspensionCountOfStudentsSuspendedDefianceOnly"),
    )
    return [first, second]


GROUP_TEXTS = {
    "RB": "english only (eo)",
    "RA": "DIS-ABILITIES",
    "GF": "female",
    "GM": "male",
    "SH": "learners (el)",
}
STAFF = {"RB": "Nurse", "RA": "Psychologist", "GF": "Counselor", "GM": "Librarian", "SH": "Social Worker"}
GRADE_TEXTS = {"GF": "3rd", "GM": "11th", "TA": "4th"}


def _wholes(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("aggregate_level").isin("T", "C") & (F.col("charter") == "All"))


def demographics(panel: DataFrame) -> DataFrame:
    """Geo, Group, Value: share of a group over all years."""
    total = F.col("reporting_category") == "TA"
    wholes = _wholes(panel)
    totals = wholes.where(total).groupBy("county_name").agg(F.sum(_people()).alias("whole"))
    parts = (
        wholes.where(~total)
        .groupBy("county_name", "reporting_category")
        .agg(F.sum(_people()).alias("part"))
    )
    return parts.join(totals, "county_name").select(
        F.lower("county_name").alias("Geo"),
        match_value("reporting_category", GROUP_TEXTS).alias("Group"),
        (F.col("part") / F.col("whole")).alias("Value"),
    )


def personnel_sheet(panel: DataFrame) -> DataFrame:
    parts = _wholes(panel).where(F.col("reporting_category") != "TA")
    return parts.groupBy("county_name", "reporting_category").agg(
        F.sum("pending").alias("Value")
    ).select(
        F.col("county_name").alias("Geo"),
        match_value("reporting_category", STAFF).alias("Group"),
        "Value",
    )


def foster(panel: DataFrame) -> DataFrame:
    return _wholes(panel).where(F.col("reporting_category") == "SH").select(
        F.col("academic_year").alias("Year"),
        F.col("county_name").alias("Geo"),
        (F.col("pending") / (_people() * 100)).alias("Rate"),
        F.col("pending").alias("Value"),
    )


def rate_sheet(panel: DataFrame, part: str, scale: int) -> DataFrame:
    """Year, Geo, Value: a yearly fraction of all students."""
    return _wholes(panel).where(F.col("reporting_category") == "TA").select(
        F.col("academic_year").alias("Year"),
        F.col("county_name").alias("Geo"),
        (F.col(part) / (_people() * scale)).alias("Value"),
    )


def graduation_sheet(panel: DataFrame) -> DataFrame:
    """Geo, Subgroup, Value: the fraction per group over all years."""
    parts = _wholes(panel).where(F.col("reporting_category") != "TA")
    sums = parts.groupBy("county_name", "reporting_category").agg(
        F.sum("affected").alias("part"), F.sum(_people()).alias("whole")
    )
    return sums.select(
        F.lower("county_name").alias("Geo"),
        match_value("reporting_category", GROUP_TEXTS).alias("Subgroup"),
        (F.col("part") / F.col("whole")).alias("Value"),
    )


def ela_sheet(panel: DataFrame) -> DataFrame:
    """Test, Geo, Group, Subgroup and one fraction per academic year."""
    tested = (
        _wholes(panel)
        .withColumn("Test", F.explode(F.array(F.lit("ELA"), F.lit("Math"))))
        .withColumn(
            "met",
            F.when(F.col("Test") == "ELA", F.col("affected")).otherwise(F.col("pending"))
            / _people(),
        )
    )
    years = found_names(tested, "academic_year")
    wide = widen(
        tested, ["county_name", "reporting_category", "Test"], "academic_year", years, ["met"]
    )
    grade = match_value("reporting_category", GRADE_TEXTS)
    return wide.select(
        "Test",
        F.lower("county_name").alias("Geo"),
        F.when(grade.isNull(), "Subgroup").otherwise("Grade").alias("Group"),
        F.coalesce(grade, match_value("reporting_category", GROUP_TEXTS)).alias("Subgroup"),
        *[F.col(f"met_{y}").alias(y) for y in years],
    )
