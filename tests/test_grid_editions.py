"""Cells of table grids, editions replaced as a whole, orders and pivots at scale, the report's plan."""

import html as markup
import random
import re
import statistics

import pytest
from almanack.operators import exact_median, first_seen_order, fixed_order, found_names, level_order, widen_found
from almanack.operators.ordering import _numbered
from almanack.plans import indicators as I
from almanack.plans import report
from almanack.plans import standins as S
from almanack.plans.panel import FOCUS, panel
from almanack.sources import editions, html_grid_cell, publish_edition, read_editions
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

# ---------------------------------------------------------------- table grids


def grid_of(table):
    """HTML's table model in plain Python; a lower cell wins a place that two cells cover."""
    held = {}
    for r, cells in enumerate(table):
        at, own = 0, {}
        for text, wide, high in cells:
            while (r, at) in held:
                at += 1
            for j in range(at, at + wide):
                for i in range(r, len(table) if high == 0 else r + high):
                    own[i, j] = text
                for i in range(r, 100):  # the cell from above ends where a lower one lies on it
                    if (i, j) not in own:
                        held.pop((i, j), None)
            at += wide
        held.update(own)
    return held


def html_of(table, tag="td"):
    def cell(c):
        spans = (f" colspan={c[1]}" if c[1] != 1 else "") + (f' ROWSPAN="{c[2]}"' if c[2] != 1 else "")
        return f"<{tag}{spans}> <b>{c[0]}</b>\n</{tag}>"

    return "<p><table border=1>" + "".join("<tr>" + "".join(map(cell, row)) + "</tr>" for row in table) + "</table>"


def test_grid_cells_equal_brute_force(spark):
    rng = random.Random(3)
    tables = []
    for t in range(12):
        high = lambda: rng.choice([1, 1, 1, 2, 3, 0])
        wide = lambda: rng.choice([1, 1, 1, 2, 3])
        tables.append([[(f"{t}.{r}.{c}", wide(), high()) for c in range(rng.randint(0, 5))] for r in range(6)])
    df = spark.createDataFrame([(i, html_of(t)) for i, t in enumerate(tables)], "i int, html string")
    places = [(r, c) for r in range(1, 8) for c in (1, 2, 3, 4, 6, 9)]
    got = df.select("i", *[html_grid_cell("html", r, c).alias(f"{r}_{c}") for r, c in places]).collect()
    for row in got:
        held = grid_of(tables[row["i"]])
        want = {(r, c): held.get((r - 1, c - 1)) if r <= 6 else None for r, c in places}
        assert {p: row[f"{p[0]}_{p[1]}"] for p in places} == want


def test_grid_headers_blocks_and_odd_spans(spark):
    head = "<table><tr><th>a</th><th>b</th></tr>"
    body = "<tr><td rowspan=\"x\" colspan='0'>1</td><td colspan=-2>2&nbsp;</td></tr></table>"
    df = spark.createDataFrame([(head + body + html_of([[("z", 2, 1)]]),), ("no table",), (None,), ("",)], "html string")

    def cell(*args, **more):
        return [r[0] for r in df.select(html_grid_cell("html", *args, **more)).collect()]

    assert cell(1, 1) == ["1", None, None, None] and cell(1, 2)[0] == "2"
    assert cell(1, 1, header=False)[0] == "a" and cell(2, 2, header=False)[0] == "2"
    assert cell(1, 2, block=2)[0] == "z" and cell(1, 3, block=2)[0] is None and cell(9, 1)[0] is None


def test_special_education_pages_hold_the_published_cell(spark, sf_dir):
    pages = S.sped_pages(spark, sf_dir)
    row = pages.orderBy("year").first()
    rows = re.findall("<tr>(.*?)</tr>", row["html"][row["html"].index("<table border=1>") :])
    written = re.findall("<td[^>]*>(.*?)</td>", rows[22])[11]
    assert written.startswith("<b>")
    value = pages.select("year", html_grid_cell("html", **report.SPED_CELL).alias("n")).where(f"year = {row['year']}").first()["n"]
    assert value == markup.unescape(re.sub("<[^>]*>", "", written)).strip("\xa0 ") and value.replace(",", "").isdigit()


# ---------------------------------------------------------------- editions


def rows_of(df):
    return sorted((r["report_year"], r["figure"], r["x"], r["y"]) for r in df.collect())


CHART = "figure string, series string, x string, y double"


def test_an_edition_replaces_the_one_before_as_a_whole(spark, tmp_path):
    path = str(tmp_path)
    assert editions(spark, path).count() == 0
    with pytest.raises(ValueError, match="no edition"):
        read_editions(spark, path)
    old = spark.createDataFrame([("f1", "s", "2015", 1.0), ("f2", "s", "2015", 2.0)], CHART)
    publish_edition(old, path, "2022")
    publish_edition(old.where("figure = 'f1'"), path, "2023")
    first = rows_of(read_editions(spark, path))
    assert first == [("2022", "f1", "2015", 1.0), ("2022", "f2", "2015", 2.0), ("2023", "f1", "2015", 1.0)]
    # A write that fails half way leaves files behind, but no edition.
    lost = F.when(F.col("figure") == "f2", F.raise_error(F.lit("lost")).cast("double")).otherwise(9.0)
    with pytest.raises(PySparkException, match="lost"):
        publish_edition(old.withColumn("y", lost).repartition(2), path, "2022")
    assert rows_of(read_editions(spark, path)) == first
    # The next one replaces all figures of its year, also those that it no longer has.
    publish_edition(old.where("figure = 'f2'").withColumn("y", F.lit(7.0)), path, "2022")
    assert rows_of(read_editions(spark, path, "2022")) == [("2022", "f2", "2015", 7.0)]
    assert rows_of(read_editions(spark, path, "2023")) == [("2023", "f1", "2015", 1.0)]


def test_an_edition_with_other_rows_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("f1", "s", "2015", 1.0)], CHART)
    edition = publish_edition(df, str(tmp_path), "2022")
    more = df.withColumn("report_year", F.lit("2022"))
    more.write.mode("append").partitionBy("report_year", "figure").parquet(f"{tmp_path}/editions/{edition}")
    with pytest.raises(ValueError, match="other rows"):
        read_editions(spark, str(tmp_path))


# ---------------------------------------------------------------- orders and pivots


def test_many_labels_are_numbered_in_ranges(spark):
    n = 300_000
    number = F.lpad(((F.col("id") * 7919) % n).cast("string"), 7, "0")
    got = _numbered(spark.range(n).select(F.concat(F.lit("l"), number).alias("k")), "k")
    assert got.where(F.col("level") != F.substring("k", 2, 7).cast("int") + 1).count() == 0
    assert got.agg(F.count_distinct("level")).first()[0] == n
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[row_number\(\) windowspecdefinition\((\w+)", plan)
    assert windows and all(w.startswith("_range") for w in windows)  # no window over all labels


def test_levels_with_ties_and_missing_values(spark):
    rows = [(f"k{i % 40:02}", None if i % 40 == 7 else float(i % 40 // 4)) for i in range(400)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [(r.k, r.level) for r in level_order(df, "k", "v").orderBy("level").collect()]
    known = [f"k{i:02}" for i in range(40) if i != 7]
    assert got == [(k, i + 1) for i, k in enumerate([*known, "k07", None])]
    assert level_order(df.where("false"), "k", "v").count() == 0


@pytest.mark.parametrize("step", [1e-13, 1e-3, 1e6])
def test_median_of_many_values_close_or_far(spark, step):
    n = 400_001
    df = spark.range(n).select(F.lit("a").alias("k"), (1 + ((F.col("id") * 7919) % n) * F.lit(step)).alias("v"))
    df = df.unionByName(spark.range(5).select(F.lit("b").alias("k"), F.col("id").cast("double").alias("v")))
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert got == {"a": statistics.median([1 + i * step for i in range(n)]), "b": 2.0}


def test_median_by_several_keys_with_nulls(spark):
    rows = [("a", None, 1.0), ("a", None, 3.0), (None, 1, 5.0), (None, 1, None), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, j int, v double")
    got = {(r.k, r.j): r.median for r in exact_median(df, ["k", "j"], "v").collect()}
    assert got == {("a", None): 2.0, (None, 1): 5.0, (None, None): None}


def test_a_fixed_order_keeps_the_order_behind_it(spark):
    df = spark.createDataFrame([("z", 1), ("11th", 2), ("m", 3), ("3rd", 4), ("a", 5), (None, 6)], "k string, i int")
    seen = first_seen_order(df, "k", "i")
    got = fixed_order(df, "k", ["3rd", "11th"], seen).orderBy("level").collect()
    assert [(r.k, r.level) for r in got] == [("3rd", 1), ("11th", 2), ("z", 3), ("m", 4), ("a", 5), (None, 6)]
    # Orders chain any number of times, and labels that the earlier order lacks come last.
    earlier = fixed_order(df.where("k <> 'm'"), "k", ["3rd"], seen)
    again = fixed_order(df, "k", ["a"], earlier).orderBy("level").collect()
    assert [r.k for r in again] == ["a", "3rd", "z", "11th", "m", None]


def test_a_pivot_finds_its_names(spark):
    rows = [("x", "2019", 1.0), ("x", "2020", 2.0), ("y", None, 3.0), ("y", "2021", None)]
    df = spark.createDataFrame(rows, "k string, year string, v double")
    wide = widen_found(df, ["k"], "year", ["v"])
    assert wide.columns == ["k", "v_2019", "v_2020", "v_2021", "v_NA"]
    assert sorted(tuple(r) for r in wide.collect()) == [("x", 1.0, 2.0, None, None), ("y", None, None, None, 3.0)]
    assert found_names(df.where("false"), "year") == []
    with pytest.raises(ValueError, match="more than 3 different"):
        widen_found(df, ["k"], "year", ["v"], most=3)


def test_other_years_become_columns(spark, sf_dir):
    rows = panel(spark, sf_dir)
    later = rows.where("academic_year = '2001-02'").withColumn("academic_year", F.lit("2011-12"))
    sheet = S.ela_sheet(rows.unionByName(later))
    assert "2011-12" in sheet.columns and "2001-02" in sheet.columns
    wide = S.caaspp_wide(rows.unionByName(later))
    assert "Percentage Standard Met and Above.29" in wide.columns


# ---------------------------------------------------------------- the report


def test_each_source_is_scanned_once(spark, sf_dir):
    sources = report.trend_sources(spark, sf_dir)
    assert report.missing_sources(sources) == []
    found = {}
    for name, make in {**report.LEVELED, **report.PLAIN}.items():
        df = make(sources[name], FOCUS, True) if name in report.LEVELED else make(sources[name], FOCUS)
        plan = df._jdf.queryExecution().executedPlan().toString()
        found[name] = len(set(re.findall(r"Scan parquet \[[^\]]*\]", plan)))  # one that is shown twice runs once
    # The four sources with charts of the newest year look that year up as well, in one column.
    assert found == {name: 2 if name in report.LEVELED else 1 for name in found}


def test_a_whole_report_refuses_to_lack_a_source(spark, sf_dir, tmp_path):
    sources = report.trend_sources(spark, sf_dir)
    del sources["UPC"], sources["CODEBOOK"]
    assert report.missing_sources(sources) == ["UPC", "CODEBOOK"]
    with pytest.raises(ValueError, match="UPC, CODEBOOK"):
        report.write_report(sources, FOCUS, str(tmp_path), "2023", whole=True)
    rows = report.stack(report.figures(sources, FOCUS))
    names = {r.figure for r in rows.select("figure").distinct().collect()}
    assert "suspension_by_group" in names and "graduation_by_group" not in names and "math_trend" in names


def test_the_report_equals_its_figures_one_by_one(spark, sf_dir):
    src = report.trend_sources(spark, sf_dir)
    book = src["CODEBOOK"]
    single = {
        "graduation_trend": I.graduation_trend(src["GRAD_FOUR"], FOCUS),
        "graduation_by_group": I.graduation_by_group(src["GRAD_FOUR"], FOCUS, book),
        "dropout_by_group": I.dropout_by_group(src["GRAD_FOUR"], FOCUS, book),
        "suspension_by_group": I.suspension_by_group(src["SUSP"], FOCUS),
        "expulsion_trend": I.expulsion_trend(src["EXP"], FOCUS),
        "expulsion_by_group": I.expulsion_by_group(src["EXP"], FOCUS),
        "ela_trend": I.assessment_trend(src["CAASPP"], FOCUS, 1),
        "math_by_group": I.assessment_by_group(src["CAASPP"], FOCUS, book, 2),
        "cumulative_enrollment_SH": I.cumulative_enrollment(src["CENROLLMENT"], FOCUS, "SH", (5000, 14000)),
        "enrollment_share_SS": I.enrollment_share(src["CENROLLMENT"], FOCUS, "SS", (0.65, 0.8)),
        "pupil_count_homeless": I.pupil_count(src["UPC"], FOCUS, "homeless", (0, 10000)),
    }
    whole = report.stack(report.figures(src, FOCUS)).collect()
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    for name, df in single.items():
        assert text(df.collect()) == text(r for r in whole if r["figure"] == name), name
