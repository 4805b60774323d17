"""Indicators on hand-written rows in the published shapes."""

import pytest
from pyspark.sql import functions as F

from almanack.operators import Geography, append_series
from almanack.plans import indicators as I
from almanack.plans.report import figures, write_report
from almanack.sources import literal_table, read_glob, read_typed_years, read_with_origin

GEO = Geography("27", "Springfield County")


def points(df, *columns):
    columns = columns or ("series", "x", "y", "label")
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def book(spark):
    return literal_table(
        spark,
        [
            ("SUSP", "RB", "African American"),
            ("SUSP", "GM", "Male"),
            ("SUSP", "GF", "Female"),
            ("CAASPP", "1", "All Students"),
            ("CAASPP", "3", "Female"),
            ("CAASPP", "74", "Black"),
            ("CAASPP", "201", "Black, disadvantaged"),
            ("CAASPP", "999", "TBD"),
        ],
        "table string, value string, definition string",
    )


@pytest.fixture(scope="module")
def grad(spark):
    cols = (
        "academic_year string, aggregate_level string, county_code string, county_name string, "
        "district_code string, reporting_category string, charter_school string, dass string, "
        "regular_hs_diploma_graduates_rate double, dropout_rate double"
    )
    c, all_ = ("C", "27", "Springfield", None), ("All", "All")
    return spark.createDataFrame(
        [
            ("2016-17", "T", "00", "State", None, "TA", *all_, 82.5, 9.1),
            ("2017-18", "T", "00", "State", None, "TA", *all_, 83.0, 9.6),
            ("2016-17", *c, "TA", *all_, 91.0, 16.0),
            ("2017-18", *c, "TA", *all_, 84.449, None),
            ("2017-18", "C", "1", "Elsewhere", None, "TA", *all_, 50.0, 50.0),
            ("2017-18", *c, "TA", "Yes", "All", 10.0, 10.0),
            ("2017-18", *c, "TA", "All", "No", 10.0, 10.0),
            ("2017-18", "D1", "27", "Springfield", "12345", "TA", *all_, 20.0, 20.0),
            ("2017-18", None, "27", "Springfield", None, "TA", *all_, 80.0, 8.0),
            ("2017-18", *c, "RB", *all_, 70.0, 1.0),
            ("2017-18", *c, "GM", *all_, 80.0, 30.0),
            ("2017-18", *c, "GF", *all_, None, 5.0),
            ("2017-18", *c, "ZZ", *all_, 60.0, 2.0),
            ("2016-17", *c, "RB", *all_, 1.0, 1.0),
        ],
        cols,
    )


def test_graduation_trend(grad):
    out = I.graduation_trend(grad, GEO)
    assert out.columns == I.CHART_COLUMNS
    assert points(out, "series", "x", "y", "y_visible", "label") == sorted(
        [
            ("California", "2016-17", 0.825, 0.825, "82%"),
            ("California", "2017-18", 0.83, 0.83, "83%"),
            ("Springfield", "2016-17", 0.91, None, "91%"),
            ("Springfield", "2017-18", 0.84449, 0.84449, "84%"),
            (None, "2017-18", 0.8, 0.8, "80%"),
        ],
        key=str,
    )
    assert {r.x for r in I.label_layer(out).collect()} == {"2017-18"}


def test_graduation_by_group(grad, book):
    out = I.graduation_by_group(grad, GEO, book)
    assert points(out, "x", "y", "label", "facet", "level") == [
        ("African American", 0.7, "70.0%", "Race/Ethnicity", 1),
        ("Male", 0.8, "80.0%", "Gender", 2),
        (None, 0.6, "60.0%", None, 3),
    ]


def test_earlier_editions(grad, discipline):
    trend = I.graduation_trend(grad, GEO, accuracy=0.1, limits=(0.7, 0.9))
    assert ("California", "82.5%") in points(trend, "series", "label")
    groups = I.graduation_by_group(grad, GEO, rated_only=False)
    assert points(groups, "x", "y", "level") == [
        ("African American", 0.7, 1), ("Female", None, 3), ("Male", 0.8, 2), (None, 0.6, 4),
    ]
    expelled = I.expulsion_trend(discipline, GEO, percent=True)
    assert ("Springfield", "0.28%") in points(expelled, "series", "label")


def test_dropout(grad, book):
    trend = points(I.dropout_trend(grad, GEO), "series", "x", "y_visible", "label")
    assert ("Springfield", "2016-17", None, "16.0%") in trend
    assert ("Springfield", "2017-18", None, None) in trend
    groups = points(I.dropout_by_group(grad, GEO, book), "x", "level")
    assert groups == [("African American", 1), ("Male", 2), (None, 3)]


def test_county_without_the_newest_year_has_no_groups(spark, grad, book):
    later = grad.where("aggregate_level = 'T'").withColumn("academic_year", F.lit("2018-19"))
    assert I.graduation_by_group(grad.unionByName(later), GEO, book).count() == 0


def test_text_files_give_the_same_trend(spark, tmp_path):
    (tmp_path / "cohort1.txt").write_text(
        "AcademicYear\tAggregateLevel\tCountyCode\tCountyName\tDistrictCode\tReportingCategory\t"
        "CharterSchool\tDASS\tRegular HS Diploma Graduates (Rate)\tDropout (Rate)\n"
        "2016-17\tT\t00\tState\t\tTA\tAll\tAll\t82.5\t*\n"
    )
    (tmp_path / "cohort2.txt").write_text(
        "Academic Year\tDASS\tAggregateLevel\tCountyCode\tCountyName\tDistrictCode\t"
        "ReportingCategory\tCharterSchool\tDropout (Rate)\tRegular HS Diploma Graduates (Rate)\n"
        "2017-18\tAll\tC\t27\tSpringfield\tNA\tTA\tAll\t10\t84\n"
        "2017-18\tAll\tC\t27\tSpringfield\t41001\tTA\tAll\t99\t99\n"
    )
    files = read_glob(spark, str(tmp_path), "cohort*txt")
    assert points(I.graduation_trend(files, GEO)) == [
        ("California", "2016-17", 0.825, "82%"),
        ("Springfield", "2017-18", 0.84, "84%"),
    ]
    assert points(I.dropout_trend(files, GEO), "x", "y") == [("2016-17", None), ("2017-18", 0.1)]


def test_college_going(spark):
    row = ("2017-18", "T", "00", "State", "TA", "All", "All", "TA", "62.44")
    cols = [
        "AcademicYear", "AggregateLevel", "CountyCode", "CountyName", "ReportingCategory",
        "CharterSchool", "AlternativeSchoolAccountabilityStatus", "CompleterType",
        "College_Going_Rate_Total_12_Months",
    ]
    county = ("2017-18", "C", "27", "Springfield", "TA", "All", "All", "TA", "*")
    other = ("2017-18", "C", "27", "Springfield", "TA", "All", "All", "AG", "1.0")
    district = ("2017-18", "D", "27", "Springfield", "TA", "All", "All", "TA", "1.0")
    df = spark.createDataFrame([row, county, other, district], cols)
    assert points(I.college_going_trend(df, GEO)) == [
        ("California", "2017-18", 0.6244, "62.4%"), ("Springfield", "2017-18", None, None),
    ]


def test_college_going_from_text_files(spark, tmp_path):
    header = (
        "AcademicYear\tAggregateLevel\tCountyCode\tCountyName\tReportingCategory\tCharterSchool\t"
        "AlternativeSchoolAccountabilityStatus\tCompleterType\tCollege Going Rate - Total (12 Months)\n"
    )
    (tmp_path / "cgr17.txt").write_text(header + "2016-17\tT\t00\tState\tTA\tAll\tAll\tTA\t64.5\n")
    (tmp_path / "cgr18.txt").write_text(header + "2017-18\tC\t27\tSpringfield\tTA\tAll\tAll\tTA\t*\n")
    files = read_glob(spark, str(tmp_path), "cgr*txt")
    assert points(I.college_going_trend(files, GEO)) == [
        ("California", "2016-17", 0.645, "64.5%"), ("Springfield", "2017-18", None, None),
    ]


def test_readiness_and_ages(spark):
    assert points(I.kindergarten_readiness(spark, GEO)) == [
        ("Springfield County", "2012", 23.0, "23%"), ("Springfield County", "2015", 25.0, "25%"),
    ]
    assert ("Under 5 years", "32,846") in points(I.age_table(spark), "age_range", "count")


def test_pupil_count(spark):
    df = spark.createDataFrame(
        [(27.0, "2016", 1000.0, 1.0), (27.0, "2016", 500.0, None), (1.0, "2016", 9.0, 9.0), (27.0, "2017", 70000.0, 2.0)],
        "County_Code double, academic_year string, total_enrollment double, homeless double",
    )
    out = I.pupil_count(df, GEO, "total_enrollment", (60000, 80000))
    assert points(out, "x", "y", "y_visible", "label") == [
        ("2016", 1500.0, None, "1,500"), ("2017", 70000.0, 70000.0, "70,000"),
    ]
    assert points(I.pupil_count(df, GEO, "homeless"), "x", "y") == [("2016", None), ("2017", 2.0)]


def test_special_education(spark):
    page = "<table><tr><td>1</td></tr><tr><td>a</td><td>7,654</td></tr></table>"
    pages = spark.createDataFrame([("2018-19", page)], "year string, html string")
    out = I.special_education(pages, GEO, row=2, cell=2)
    assert points(out) == [("Springfield County", "2018-19", 7654.0, "7,654")]


def test_cumulative_enrollment_and_share(spark):
    cols = "academic_year string, aggregate_level string, county_code string, county_name string, charter string, reporting_category string, cumulative_enrollment string"
    row = lambda cat, n, y="2017-18", charter="All": (y, "C", "27", "Springfield", charter, cat, n)
    df = spark.createDataFrame(
        [row("TA", "80000"), row("SS", "60000"), row("SS", "7", charter="Y"), row("TA", "0", "2018-19"), row("SS", "*", "2018-19")],
        cols,
    )
    assert points(I.cumulative_enrollment(df, GEO, "SS"), "x", "y", "label") == [
        ("2017-18", 60000.0, "60,000"), ("2018-19", None, None),
    ]
    assert points(I.enrollment_share(df, GEO, "SS", (0.65, 0.8)), "x", "y", "label") == [
        ("2017-18", 0.75, "75.0%"), ("2018-19", None, None),
    ]


@pytest.fixture(scope="module")
def discipline(spark):
    cols = (
        "academic_year string, aggregate_level string, county_code string, county_name string, "
        "district_code string, charter_yn string, reporting_category string, "
        "suspension_rate_total double, unduplicated_count_of_students_expelled_total double, "
        "cumulative_enrollment double"
    )
    return spark.createDataFrame(
        [
            ("2016-17", "T", "00", "State", None, None, "TA", 3.6, 1.0, 1000.0),
            ("2016-17", "C", "27", "Springfield", None, "", "TA", 4.4, 0.0, 0.0),
            ("2017-18", "C", "27", "Springfield", None, "All", "TA", 4.2, 285.0, 1_000_000.0),
            ("2017-18", "C", "27", "Springfield", None, "N", "TA", 9.9, 9.0, 10.0),
            ("2017-18", "C", "27", "Springfield", "41001", "All", "TA", 9.9, 9.0, 10.0),
            ("2017-18", "C", "27", "Springfield", None, "All", "RB", 8.0, 3.0, 1000.0),
            ("2017-18", "C", "27", "Springfield", None, "All", "GX", 2.0, None, 1000.0),
            ("2017-18", "C", "27", "Springfield", None, "All", "QQ", 1.0, 1.0, 1000.0),
        ],
        cols,
    )


def test_suspension(discipline):
    assert points(I.suspension_trend(discipline, GEO)) == [
        ("California", "2016-17", 3.6, "3.6%"),
        ("Springfield", "2016-17", 4.4, "4.4%"),
        ("Springfield", "2017-18", 4.2, "4.2%"),
    ]
    assert points(I.suspension_by_group(discipline, GEO), "x", "y", "facet", "level") == [
        ("African American", 0.08, "Race/Ethnicity", 2), ("Non-Binary", 0.02, "Gender", 1), (None, 0.01, None, 3),
    ]


def test_expulsion(discipline):
    assert points(I.expulsion_trend(discipline, GEO)) == [
        ("California", "2016-17", 1.0, "1"),
        ("Springfield", "2016-17", None, None),
        ("Springfield", "2017-18", 0.285, "0.28"),
    ]
    assert points(I.expulsion_by_group(discipline, GEO), "x", "y", "label", "level") == [
        ("African American", 3.0, "3", 1), ("Non-Binary", None, None, 2), (None, 1.0, "1", 3),
    ]


SUSP_1 = (
    "Academic Year\tAggregate Level\tCounty Code\tCounty Name\tDistrict Code\tDistrict Name\tSchool Code\t"
    "CharterYN\tReporting Category\tCumulative Enrollment\tTotal Suspensions\t"
    "Unduplicated Count of Students Suspended (Total)\tSuspension Count Defiance Only\n"
    "2016-17\tD1\t27\tSpringfield\t41001\tNorthfield Union\t0\tN\tTA\t1000\t100\t50\t5\n"
    "2016-17\tD2\t27\tSpringfield\t41002\tRiverton\tNA\tN\tTA\t1000\t10\t30\t6\n"
    "2016-17\tT\t00\tState\t\t\t\tAll\tTA\t9000\t90\t80\t7\n"
)
SUSP_2 = (
    "AcademicYear\tCharterYn\tAggregateLevel\tCountyCode\tCountyName\tDistrictCode\tDistrictName\tSchoolCode\t"
    "ReportingCategory\tCumulativeEnrollment\tTotalSuspensions\tUnduplicatedCountOfStudentsSuspendedTotal\t"
    "SuspensionCountOfStudentsSuspendedDefianceOnly\n"
    "2017-18\tNo \tD1\t27\tSpringfield\t41001\tNorthfield Union\t0\tTA\t500\t*\t20\t1\n"
    "2017-18\tNo \tD1\t27\tSpringfield\t41003\tElsewhere\t0\tTA\t499\t499\t1\t1\n"
    "2017-18\tNo \tD1\t27\tSpringfield\t41001\tNorthfield Union\t777\tTA\t500\t5\t500\t1\n"
    "2017-18\tNo \tD2\t27\tSpringfield\t41002\tRiverton\t\tTA\t0\t3\t*\t1\n"
    "2017-18\tAll\tC\t27\tSpringfield\t\t\t\tTA\t5000\t50\t40\t9\n"
)


@pytest.fixture
def susp_files(spark, tmp_path):
    (tmp_path / "susp1617.txt").write_text(SUSP_1)
    (tmp_path / "susp1718.txt").write_text(SUSP_2)
    return read_glob(spark, str(tmp_path), "susp*txt")


def test_suspension_burden(susp_files):
    burden = lambda **k: [(r.district_code, r.burden) for r in I.suspension_burden(susp_files, "TA", **k).collect()]
    assert burden(year="2017-18") == [("41003", 100.0), ("41001", None), ("41002", None)]
    assert burden(year="2017-18", floor=500) == [("41001", None)]
    assert burden(district="41001") == [("41001", 10.0), ("41001", None)]
    assert burden(district="41001", school_totals=False) == [("41001", 10.0), ("41001", 1.0), ("41001", None)]


def test_pooled_districts(spark, susp_files):
    pool = I.district_pool(susp_files, GEO, ["Northfield", "River"], "Five districts")
    assert points(pool, "academic_year", "rate", "geo") == [
        ("2016-17", 0.04, "Five districts"), ("2017-18", None, "Five districts"),
    ]
    sheet = spark.createDataFrame([("2016-17", 0.05, "California")], "Year string, Value double, Geo string")
    both = append_series(sheet, pool, {"Year": "academic_year", "Value": "rate", "Geo": "geo"})
    assert both.count() == 3


def test_discipline_frame_merges_the_renamed_measure(susp_files):
    old, new = "suspension_count_defiance_only", "suspension_count_of_students_suspended_defiance_only"
    out = I.discipline_frame(susp_files, GEO, ["cumulative_enrollment"], either=(old, new))
    assert points(out, "academic_year", "geo", "cumulative_enrollment", f"{new}2") == [
        ("2016-17", "California", 9000.0, 7.0), ("2017-18", "Springfield", 5000.0, 9.0),
    ]


def test_fitness(spark, tmp_path):
    header = "CO,Level_Number,Report_Number,Table_Number,Line_Number,NoStud5,Perc5b,Line_Text,NoStud7,Perc7b,NoStud9,Perc9b\n"
    (tmp_path / "2017_18.txt").write_text(
        header
        + "0,4,0,2,3,1,60,a,2,65,3,81\n0,4,0,2,8,400,1,b,500,1,600,1\n"
        + "27,3,0,2,3,1,49.9,a,2,55.5,3,*\n27,3,0,2,8,4,1,b,5,1,6,1\n"
        + "27,2,0,2,3,9,9,x,9,9,9,9\n1,3,0,2,3,9,9,x,9,9,9,9\n27,3,1,2,3,9,9,x,9,9,9,9\n27,3,0,2,5,9,9,x,9,9,9,9\n"
    )
    pft, skipped = read_typed_years(
        spark, {y: f"{tmp_path}/{y}.txt" for y in ("2018_19", "2017_18")}, "nnnnnnncnnnn"
    )
    assert skipped == ["2018_19"]
    out = I.fitness_by_grade(pft, GEO)
    assert points(out, "series", "x", "y", "y_visible", "label") == [
        ("California 5", "2017_18", 0.6, 0.6, "60%"),
        ("California 7", "2017_18", 0.65, 0.65, "65%"),
        ("California 9", "2017_18", 0.81, None, "81%"),
        ("Springfield 5", "2017_18", 0.499, None, "50%"),
        ("Springfield 7", "2017_18", 0.555, 0.555, "56%"),
        ("Springfield 9", "2017_18", None, None, None),
    ]


@pytest.fixture(scope="module")
def caaspp(spark):
    row = lambda county, sub, met, year=2022, test=1, grade=13, district="00000": (county, district, grade, test, year, sub, met)
    return spark.createDataFrame(
        [
            row("00", 1, "47.06"),
            row("27", 1, "35.15"),
            row("27", 1, "33.0", year=2021),
            row("27", 1, "20.0", test=2),
            row("27", 1, "1", grade=11),
            row("27", 1, "1", district="41001"),
            row("01", 1, "1"),
            row("27", 3, "40.0"),
            row("27", 74, "*"),
            row("27", 201, "10.0"),
            row("27", 999, "10.0"),
            row("27", 555, "10.0"),
        ],
        "County_Code string, District_Code string, Grade int, Test_Id int, Test_Year int, Subgroup_ID int, Percentage_Standard_Met_and_Above string",
    )


def test_assessment_trend(caaspp):
    assert points(I.assessment_trend(caaspp, GEO, 1)) == [
        ("California", "2022", 0.4706, "47.1%"),
        ("Springfield County", "2021", 0.33, "33.0%"),
        ("Springfield County", "2022", 0.3515, "35.2%"),
    ]


def test_assessment_by_group(caaspp, book):
    out = I.assessment_by_group(caaspp, GEO, book, 1)
    assert points(out, "x", "y", "facet", "level") == [
        ("All Students", 0.3515, "All \nStudents", 1),
        ("Black", None, "Race and \nEthnicity", 3),
        ("Female", 0.4, "Gender", 2),
    ]


def test_wide_assessment_file(spark):
    cols = [
        "Subgroup ID", "Student Group", "Demographic Name", "County Code", "District Code", "Grade", "TestID",
        "Percentage Standard Met and Above.19", "Percentage Standard Met and Above.18", "Percentage Standard Met and Above.17",
    ]
    row = lambda sub, name, county, *met, grade="Overall": (sub, "G", name, county, "00000", grade, "ELA", *met)
    df = spark.createDataFrame(
        [
            row(1, "All", "27", 40.0, 39.0, 38.0),
            row(1, "All", "00", 51.0, 50.0, None),
            row(1, "All", "27", 1.0, 1.0, 1.0, grade="11"),
            row(190, "Out", "27", 1.0, 1.0, 1.0),
            row(212, "Out", "27", 1.0, 1.0, 1.0),
            row(3, "Male", "27", 30.0, 1.0, 1.0),
        ],
        cols,
    )
    assert points(I.assessment_wide_trend(df, GEO, "ELA"), "series", "x", "y") == sorted(
        [
            ("Springfield County", "2018-19", 0.4), ("Springfield County", "2017-18", 0.39),
            ("Springfield County", "2016-17", 0.38), ("California", "2018-19", 0.51),
            ("California", "2017-18", 0.5), ("California", "2016-17", None),
        ],
        key=str,
    )
    assert points(I.assessment_wide_by_group(df, GEO, "ELA"), "x", "y", "level") == [
        ("All", 0.4, 2), ("Male", 0.3, 1),
    ]


def test_reclassification_table_and_files(spark, tmp_path):
    table = spark.createDataFrame(
        [("Springfield", "reclass19", 5.0, 50.0), ("Springfield", "reclass19", 6.0, 60.0), ("Springfield", "reclass10", 1.0, None), ("Other", "reclass19", 9.0, 9.0)],
        "County string, YEAR string, Reclass double, EL double",
    )
    wanted = [
        ("EL Enrollment", "2009-2010", None, None),
        ("EL Enrollment", "2018-2019", 110.0, "110"),
        ("Reclassified Students", "2009-2010", 1.0, "1"),
        ("Reclassified Students", "2018-2019", 11.0, "11"),
    ]
    assert points(I.reclassification(table, GEO)) == wanted
    (tmp_path / "reclass19.txt").write_text("CDS\tReclass\tEL\n2741001\t5\t50\n2741002\t6\t60\n0127000\t9\t9\n")
    (tmp_path / "reclass10.txt").write_text("CDS\tReclass\tEL\n2741001\t1\tNA\n")
    paths = [f"{tmp_path}/reclass{y}.txt" for y in (19, 10)]
    files = read_with_origin(spark, paths)
    assert points(I.reclassification(files, GEO, source="files")) == wanted


def test_language_status(spark):
    df = spark.createDataFrame(
        [("Springfield", None, "ALL", "2018", 10.0, 20.0), ("Springfield", None, "ALL", "2018", 1.0, 2.0), ("Springfield", None, "F", "2018", 9.0, 9.0), ("Springfield", "Union", "ALL", "2018", 9.0, 9.0)],
        "CountyName string, DistrictName string, Gender string, AcademicYear string, RFEP double, EL double",
    )
    assert points(I.language_status(df, GEO), "series", "x", "y") == [
        ("EL Enrollment", "2018", 22.0), ("Reclassified Students", "2018", 11.0),
    ]


def test_sheets(spark):
    demo = spark.createDataFrame(
        [("springfield", "english learners (el)", 0.4), ("California", "english learners (el)", 0.2), ("California", "white", 0.25)],
        "Geo string, Group string, Value double",
    )
    assert points(I.sheet_by_group(demo, "demographics", "Springfield"), "series", "x", "label", "level") == [
        ("California", "English Learners (ELs)", "20%", 2),
        ("California", "White", "25%", 1),
        ("Springfield County", "English Learners (ELs)", "40%", 2),
    ]
    staff = spark.createDataFrame(
        [("California", "Nurse", 2410.0), ("California", "Social Worker", 1.0), ("Springfield", "Counselor", 612.5)],
        "Geo string, Group string, Value double",
    )
    assert points(I.personnel(staff), "x", "label", "level") == [("Counselor", "612.5", 1), ("Nurse", "2410", 2)]
    trend = spark.createDataFrame([("2017-18", "California", 0.0054, 9)], "Year string, Geo string, Rate double, Value int")
    assert points(I.sheet_trend(trend, "foster", "rate", 0.01, (0, 0.008))) == [
        ("California", "2017-18", 0.0054, "0.54%")
    ]


def test_assessment_sheet(spark):
    df = spark.createDataFrame(
        [
            ("ELA", "springfield", "Grade", "11th", 0.5, 0.55),
            ("ELA", "springfield", "Grade", "3rd", 0.3, 0.65),
            ("ELA", "California", "Grade", "3rd", 0.4, 0.45),
            ("ELA", "springfield", "Subgroup", "eo", 0.4, None),
            ("Math", "springfield", "Subgroup", "eo", 0.245, 0.3),
        ],
        ["Test", "Geo", "Group", "Subgroup", "2016-17", "2017-18"],
    )
    long = I.assessment_sheet(df, "Springfield")
    assert long.columns == ["Test", "Geo", "Group", "Subgroup", "Year", "value"]
    assert long.count() == 10
    by_grade = I.assessment_sheet_by_grade(df, "Springfield", "ELA", "Springfield County", (0.2, 0.6))
    assert points(by_grade, "series", "x", "y_visible", "level") == [
        ("11th", "2016-17", 0.5, 2), ("11th", "2017-18", 0.55, 2), ("3rd", "2016-17", 0.3, 1), ("3rd", "2017-18", None, 1),
    ]
    by_group = I.assessment_sheet_by_group(df, "Springfield", "ELA", "2016-17")
    assert points(by_group, "series", "x", "label") == [("Springfield County", "EO", "40%")]
    assert points(I.assessment_table(df, ["2016-17", "2017-18"], "Math"), "Subgroup", "`2016-17`", "`2017-18`") == [
        ("eo", "24%", "30%")
    ]


def test_report_is_written_per_figure(spark, tmp_path, grad, discipline, caaspp, book):
    sources = {"GRAD_FOUR": grad, "SUSP": discipline, "EXP": discipline, "CAASPP": caaspp, "CODEBOOK": book}
    write_report(sources, GEO, str(tmp_path / "r"), "2023")
    back = spark.read.parquet(str(tmp_path / "r"))
    names = {r.figure for r in back.select("figure").distinct().collect()}
    assert {"graduation_trend", "graduation_by_group", "suspension_by_group", "ela_by_group", "math_trend"} <= names
    assert back.where("report_year = 2023").count() == back.count()
    assert figures({}, GEO) == []
