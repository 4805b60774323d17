import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from almanack.operators import at_latest
from almanack.sources import (
    adopt_header,
    below_header,
    clean_names,
    conform,
    html_cell,
    list_files,
    literal_table,
    load_table,
    read_glob,
    read_typed,
    read_typed_years,
    read_with_origin,
    read_years,
    snake,
    stage_table,
    student_groups,
    write_chart_rows,
    write_report_table,
)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.fixture
def drifting(tmp_path):
    (tmp_path / "susp1.txt").write_text(
        "Academic Year\tCharterYN\tTotal Count\nA\tN\t1\n B \t\t*\nC\tNA\t1,234\n"
    )
    (tmp_path / "susp2.txt").write_text(
        "Charter Yn\tTotal Count\tAcademicYear\tExtra %\nNo \t7\tD\tx\n\"\"\t8\tE\ty\n"
    )
    (tmp_path / "susp3.txt").write_text("Academic Year\tCharterYN\tTotal Count\nF\tY\t9\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    return tmp_path


def test_clean_names():
    names = ["Academic Year", "CharterYN", "Charter Yn", "DASS", "Total # of (Students)", "1st", "%", "CountyCode"]
    assert clean_names(names) == [
        "AcademicYear", "CharterYn", "CharterYn_2", "Dass", "TotalNumberOfStudents", "X1st",
        "Percent", "CountyCode",
    ]
    assert clean_names(["College_Going_Rate_Total_12_Months", "NoStud5", "Test_Id", "RFEP"], "snake") == [
        "college_going_rate_total_12_months", "no_stud5", "test_id", "rfep",
    ]
    assert len({n.lower() for n in clean_names(names)}) == len(names)


def test_snake_names_do_not_depend_on_the_way_there():
    raw = [
        "College Going Rate - Total (12 Months)", "NoStud5", "Perc5b", "County Code", "CDS",
        "Unduplicated Count of Students Suspended (Total)", "Test_Id", "CharterYN",
    ]
    direct = clean_names(raw, "snake")
    assert direct == [
        "college_going_rate_total_12_months", "no_stud5", "perc5b", "county_code", "cds",
        "unduplicated_count_of_students_suspended_total", "test_id", "charter_yn",
    ]
    assert clean_names(clean_names(raw), "snake") == direct


def test_files_with_drifting_headers_are_united_by_name(spark, drifting):
    df = read_glob(spark, str(drifting), "susp*txt")
    assert sorted(c.lower() for c in df.columns) == [
        "academicyear", "charteryn", "extrapercent", "totalcount",
    ]
    assert rows(df, "AcademicYear", "CharterYn", "TotalCount", "ExtraPercent") == sorted(
        [
            ("A", "N", "1", None),
            ("B", None, "*", None),
            ("C", None, "1,234", None),
            ("D", "No", "7", "x"),
            ("E", None, "8", "y"),
            ("F", "Y", "9", None),
        ],
        key=str,
    )


def test_files_with_one_header_share_a_scan(spark, drifting):
    plan = read_glob(spark, str(drifting), "susp*txt")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("FileScan text") == 1


def test_list_files_is_sorted_and_globs(spark, drifting):
    names = [p.rsplit("/", 1)[1] for p in list_files(spark, f"{drifting}/susp*txt")]
    assert names == ["susp1.txt", "susp2.txt", "susp3.txt"]


def test_missing_and_empty_files_are_reported(spark, drifting):
    (drifting / "empty.txt").write_text("")
    paths = [f"{drifting}/{n}.txt" for n in ("susp1", "nowhere", "empty", "susp2")]
    df, skipped = read_years(spark, paths)
    assert skipped == [paths[1], paths[2]]
    assert df.count() == 5
    assert read_years(spark, [paths[1]]) == (None, [paths[1]])
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_glob(spark, str(drifting), "*.none")
    with pytest.raises(ValueError, match="nothing to read"):
        read_glob(spark, str(drifting), "empty*")


def test_rows_carry_their_file(spark, drifting):
    paths = [f"{drifting}/susp1.txt", f"{drifting}/susp3.txt"]
    df = read_with_origin(spark, paths)
    assert rows(df.groupBy("year").count(), "year", "count") == [("susp1.txt", 3), ("susp3.txt", 1)]


def test_types_are_pinned_by_position(spark, tmp_path):
    (tmp_path / "y1.txt").write_text('CO,Text,Perc\n27,"Met, 4 of 6","1,234.5"\n0,NA,*\n')
    df = read_typed(spark, f"{tmp_path}/y1.txt", "ncn")
    assert df.dtypes == [("CO", "double"), ("Text", "string"), ("Perc", "double")]
    assert rows(df, "CO", "Text", "Perc") == [(0.0, None, None), (27.0, "Met, 4 of 6", 1234.5)]
    with pytest.raises(ValueError, match="does not have 2 columns"):
        read_typed(spark, f"{tmp_path}/y1.txt", "nc")
    both, skipped = read_typed_years(
        spark, {"y1": f"{tmp_path}/y1.txt", "y2": f"{tmp_path}/y2.txt"}, "ncn"
    )
    assert skipped == ["y2"] and {r.year for r in both.collect()} == {"y1"}


def test_positional_header_and_sheet_range(spark):
    sheet = spark.createDataFrame(
        [(1, "title", None), (2, "Year", "Total"), (3, "2014-15", "10"), (4, "2015-16", "11"), (5, "note", None)],
        "row int, a string, b string",
    )
    df = below_header(sheet, "row", 2, ["year", "total"], last_row=4)
    assert rows(df, "year", "total") == [("2014-15", "10"), ("2015-16", "11")]
    with pytest.raises(ValueError, match="cannot take"):
        adopt_header(sheet, ["a"])


def test_snake_makes_codes_text(spark):
    df = spark.createDataFrame([(27.0, "00000", 13)], "County_Code double, DistrictCode string, Grade int")
    out = snake(df, ["county_code", "district_code", "grade", "absent"])
    assert out.dtypes == [("county_code", "string"), ("district_code", "string"), ("grade", "string")]
    assert out.first().county_code == "27"
    assert conform(df).columns == ["CountyCode", "DistrictCode", "Grade"]


def test_lookup_editions(spark):
    assert student_groups(spark).count() == 20
    assert student_groups(spark, first_edition=True).count() == 18


def test_literal_table_is_local(spark):
    df = literal_table(spark, [("a", 1), (None, 2)], "k string, v int")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df, "k", "v") == [("a", 1), (None, 2)]


def test_html_cell(spark):
    page = (
        "<html><body><center><TABLE class='a'>\n<tr><th>Year</th><th>Total</th></tr>"
        "<tr><td>2018</td>\n<td align=right><b>9,876&nbsp;</b></td></tr></TABLE></center>"
        "<table><tr><td>x &amp; y</td></tr></table></body></html>"
    )
    df = spark.createDataFrame([(page,), ("<p>none</p>",), (None,)], "html string").coalesce(1)
    cell = lambda **k: [r[0] for r in df.select(html_cell("html", **k)).collect()]
    assert cell(row=2, cell=2) == ["9,876", None, None]
    assert cell(row=1, cell=1, block=2) == ["x & y", None, None]
    assert cell(row=3, cell=1) == [None, None, None]


def test_tables_from_folder_and_catalog(spark, tmp_path, sf_dir):
    assert load_table(spark, "nation", root=sf_dir).count() == 25
    load_table(spark, "nation", root=sf_dir).createOrReplaceTempView("nation_view")
    assert load_table(spark, "nation_view").count() == 25


def test_latest_year_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("2016-17", 1), ("2017-18", 2)], "academic_year string, v int")
    path = str(tmp_path / "staged")
    stage_table(df, path)
    out = at_latest(spark.read.parquet(path), "academic_year")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(academic_year" in plan
    assert [tuple(r) for r in out.select("academic_year", "v").collect()] == [("2017-18", 2)]


def test_editions_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "charts")
    frame = spark.createDataFrame(
        [("f1", "s", "2016", 1.0), ("f1", "s", "2015", 2.0), ("f2", "s", "2016", 3.0)],
        "figure string, series string, x string, y double",
    )
    write_chart_rows(frame, path, "2022")
    write_chart_rows(frame.where("figure = 'f1'"), path, "2023")
    write_chart_rows(frame.where("figure = 'f1'").withColumn("y", F.col("y") * 10), path, "2022")
    got = spark.read.parquet(path)
    assert rows(got, "report_year", "figure", "x", "y") == sorted(
        [
            (2022, "f1", "2016", 10.0),
            (2022, "f1", "2015", 20.0),
            (2022, "f2", "2016", 3.0),
            (2023, "f1", "2016", 1.0),
            (2023, "f1", "2015", 2.0),
        ],
        key=str,
    )


def test_report_table_is_written(spark, tmp_path):
    df = spark.createDataFrame([("a", "12%")], "Subgroup string, rate string")
    write_report_table(df, str(tmp_path / "t"))
    back = spark.read.csv(str(tmp_path / "t"), header=True)
    assert rows(back, "Subgroup", "rate") == [("a", "12%")]


def test_codes_have_one_width(spark):
    numbers = spark.createDataFrame([(5, 0.0), (27, 12345.0), (None, None)], "County_Code int, DistrictCode double")
    texts = spark.createDataFrame([("05", "00000"), ("27", "12345"), ("027", "1")], "CountyCode string, District_Code string")
    pairs = lambda df: [tuple(r) for r in snake(df, ["county_code", "district_code"]).collect()]
    assert pairs(numbers) == [("05", "00000"), ("27", "12345"), (None, None)]
    assert pairs(texts) == [("05", "00000"), ("27", "12345"), ("027", "00001")]


def test_a_figure_is_one_file(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('f', id % 2) AS figure", "'s' AS series", "cast(40 - id AS string) AS x").repartition(8)
    write_chart_rows(rows, str(tmp_path), "2024")
    for figure in ("f0", "f1"):
        assert len(list((tmp_path / "report_year=2024" / f"figure={figure}").glob("part-*"))) == 1


def test_a_literal_table_may_be_empty(spark):
    assert literal_table(spark, [], "a int, b string").collect() == []
