"""The yearly report: every figure's rows from one set of sources.

Each source is scanned once for all its figures, with the filters of all of them pushed down, and a table whose
charts show the newest year once more for that year alone, a column. A row of the scan becomes a chart row for
every figure that it belongs to. Category levels are numbered over the rows of one chart, which hold one county's
groups in one year; the functions of ``indicators`` make the same rows figure by figure, at any size of a chart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanack.functions import bucket_of, category_family, comma_label, percent_label, round_half_away
from almanack.operators import Geography, geo_column, group_sums, in_geography, numbers_in, stack
from almanack.plans import indicators as I
from almanack.plans import standins as S
from almanack.plans.panel import FOCUS, panel
from almanack.sources import STUDENT_GROUPS, literal_table, snake, write_chart_rows

# Categories charted, with their axis limits.
ENROLLMENT_LIMITS = {
    "TA": (70000, 85000),
    "SH": (5000, 14000),
    "SS": (55000, 65000),
    "SE": (20000, 40000),
    "SD": (6000, 12000),
}
# Pupil counts charted, with their axis limits.
COUNT_LIMITS = {
    "total_enrollment": (60000, 80000),
    "homeless": (0, 10000),
    "unduplicated_frpm_eligible_count": (50000, 60000),
    "english_learner_el": (25000, 35000),
}
# The place of the charted cell in the special education page's only table.
SPED_CELL = {"row": 22, "column": 15}
#: The list of student groups that is written out here, beside the tables of the code book.
GROUPS = "student groups"

Point = tuple[Column, Column]  # a condition and the chart row of the rows that meet it


# ---------------------------------------------------------------- several figures of one scan


def _row(
    *args: object, book: str | None = None, code: Column | None = None, listed: bool = False, **more: object
) -> Column:
    """A chart row; by-group rows name the code list that their label comes from.

    ``listed`` rows are shown only if the list has a name for them that is no placeholder.
    """
    code = F.lit(None) if code is None else code
    extra = [F.lit(book).cast("string").alias("book"), code.cast("string").alias("code"), F.lit(listed).alias("listed")]
    return F.struct(*I.fields(*args, **more), *extra)


def one_scan(df: DataFrame, points: list[Point]) -> DataFrame:
    """The chart rows of several figures; rows that belong to none are filtered before anything else."""
    kept = df.where(reduce(or_, [c for c, _ in points]))
    rows = kept.select(F.explode(F.array(*[F.when(c, p) for c, p in points])).alias("row"))
    return rows.where("row IS NOT NULL").select("row.*")


def _with_newest(df: DataFrame, year: str) -> tuple[DataFrame, Column]:
    """The frame with its newest year, and the condition that a row is of that year."""
    return df.withColumn("newest", df.select(F.max(year)).scalar()), F.col(year) == F.col("newest")


def _leveled(rows: DataFrame, books: DataFrame) -> DataFrame:
    """Names from the code lists and levels by median for by-group rows; other rows stay as they are."""
    rows = rows.join(books, ["book", "code"], "left")
    name = F.col("name")
    rows = rows.where(~F.col("listed") | ~F.coalesce(name.rlike("TBD"), F.lit(True)))
    grouped = F.col("book").isNotNull()
    rows = rows.withColumn("x", F.when(grouped, name).otherwise(F.col("x")))
    value = F.when(grouped & ~F.isnan("y"), F.col("y"))
    rows = rows.withColumn("middle", F.median(value).over(W.partitionBy("figure", "x")))
    order = [F.col("x").isNull(), F.col("middle").asc_nulls_last(), F.col("x")]
    level = F.dense_rank().over(W.partitionBy("figure").orderBy(*order))
    return rows.withColumn("level", F.when(grouped, level)).select(I.CHART_COLUMNS)


def _graduation(table: DataFrame, geo: Geography, named: bool) -> DataFrame:
    df, whole = I._cohort(table)
    graduated, dropped = "regular_hs_diploma_graduates_rate", "dropout_rate"
    df = numbers_in(df, [graduated, dropped])
    total = F.col("reporting_category") == "TA"
    trend = in_geography(geo) & whole & total
    rates = {"graduation": (F.col(graduated) / 100, 1, (0.75, 0.9)), "dropout": (F.col(dropped) / 100, 0.1, (0, 0.15))}
    points = [
        (trend, _row(f"{n}_trend", "academic_year", r, series=geo_column(geo), label=percent_label(r, a), limits=lim))
        for n, (r, a, lim) in rates.items()
    ]
    if named:
        df, newest = _with_newest(df, "academic_year")
        shown = (F.col("county_code") == geo.county_code) & whole & F.col(graduated).isNotNull() & ~total & newest
        points += [(shown, _by_group(f"{n}_by_group", r, percent_label(r, 0.1), "SUSP")) for n, (r, *_) in rates.items()]
    return one_scan(df, points)


def _by_group(figure: str, value: Column, label: Column, book: str) -> Column:
    category = F.col("reporting_category")
    return _row(figure, F.lit(None), value, label=label, facet=category_family(category), book=book, code=category)


def _discipline(
    df: DataFrame, geo: Geography, figure: str, trend: Column, label: Column, group: Column, group_label: Column
) -> DataFrame:
    total = F.col("reporting_category") == "TA"
    df, newest = _with_newest(df, "academic_year")
    shown = (F.col("county_code") == geo.county_code) & ~total & newest
    line = _row(f"{figure}_trend", "academic_year", trend, series=geo_column(geo), label=label)
    bars = _by_group(f"{figure}_by_group", group, group_label, GROUPS)
    return one_scan(df, [(in_geography(geo) & total, line), (shown, bars)])


def _suspension(table: DataFrame, geo: Geography) -> DataFrame:
    rate = F.col("suspension_rate_total")
    df = I._discipline(table, "suspension_rate_total")
    share = rate / 100
    return _discipline(df, geo, "suspension", rate, percent_label(share, 0.1), share, percent_label(share, 0.1))


def _expulsion(table: DataFrame, geo: Geography) -> DataFrame:
    rate = F.col("rate")
    text = I._number_text(round_half_away(rate, 2))
    return _discipline(I._expelled(table), geo, "expulsion", rate, text, rate, text)


def _assessments(table: DataFrame, geo: Geography, named: bool) -> DataFrame:
    df = I._assessed(table, geo, None)
    share = F.col("met") / 100
    families = {name: [str(i) for i in ids] for name, ids in I.SUBGROUP_FAMILIES.items()}
    family = bucket_of("subgroup_id", families)
    points, newest = [], F.lit(False)
    if named:
        df, newest = _with_newest(df, "test_year")
    for test in (1, 2):
        tested, name = F.col("test_id") == str(test), I._test_name(test)
        line = _row(f"{name}_trend", "test_year", share, series=F.col("geo"), label=percent_label(share, 0.1), limits=(0, 0.6))
        points.append((tested & (F.col("subgroup_id") == "1"), line))
        if named:
            shown = tested & newest & (F.col("county_code") == geo.county_code) & ~family.rlike("Ethnicity for")
            label, code = percent_label(share, 0.1), F.col("subgroup_id")
            bars = _row(f"{name}_by_group", F.lit(None), share, label=label, facet=family, book="CAASPP", code=code, listed=True)
            points.append((shown, bars))
    return one_scan(df, points)


def _enrollment(table: DataFrame, geo: Geography) -> DataFrame:
    """Counts per category and a share, from one row per year that holds the charted categories."""
    df = I._enrollment(table, geo).where(F.col("reporting_category").isin(list(ENROLLMENT_LIMITS)))
    pair = F.struct(F.col("reporting_category").alias("category"), F.col("cumulative_enrollment").alias("people"))
    years = df.groupBy("academic_year").agg(F.collect_list(pair).alias("pairs"))
    part, total = (_single("pairs", c) for c in ("SS", "TA"))
    share = F.try_divide(part, total)
    county = F.lit(geo.county_name)
    either = F.exists("pairs", lambda p: p["category"].isin("SS", "TA"))
    shown = _row("enrollment_share_SS", "academic_year", share, series=county, label=percent_label(share, 0.1), limits=(0.65, 0.8))

    def counted(category: str, limits: tuple[float, float]) -> Column:
        of_it = F.filter("pairs", lambda p: p["category"] == category)
        figure = f"cumulative_enrollment_{category}"
        return F.transform(
            of_it,
            lambda p: _row(figure, "academic_year", p["people"], series=county, label=comma_label(p["people"]), limits=limits),
        )

    rows = F.concat(*[counted(c, lim) for c, lim in ENROLLMENT_LIMITS.items()], F.when(either, F.array(shown)).otherwise(F.array().cast(f"array<{ROW}>")))
    return years.select(F.explode(rows).alias("row")).select("row.*").select(I.CHART_COLUMNS)


ROW = (
    "struct<figure:string,series:string,x:string,y:double,y_visible:double,label:string,facet:string,level:int,"
    "book:string,code:string,listed:boolean>"
)


def _single(pairs: str, category: str) -> Column:
    """The people of a category in a year; a second row for it fails the job."""
    found = F.filter(pairs, lambda p: p["category"] == category)
    twice = F.raise_error(F.lit("several rows for one cell")).cast("double")
    return F.when(F.size(found) > 1, twice).otherwise(F.get(found, F.lit(0))["people"])


def _pupil_counts(table: DataFrame, geo: Geography) -> DataFrame:
    df = snake(table, I.CODES).where(F.col("county_code") == geo.county_code)
    sums = group_sums(df, ["academic_year"], {m: m for m in COUNT_LIMITS})
    points = [
        (F.lit(True), _row(f"pupil_count_{m}", "academic_year", F.col(m), series=F.lit(geo.county_name), label=comma_label(m), limits=lim))
        for m, lim in COUNT_LIMITS.items()
    ]
    return one_scan(sums, points).select(I.CHART_COLUMNS)


# ---------------------------------------------------------------- the report

#: The sources of a report by their published names, and whether their figures need the code book.
LEVELED: dict[str, Callable[..., DataFrame]] = {
    "GRAD_FOUR": _graduation,
    "SUSP": lambda t, geo, named: _suspension(t, geo),
    "EXP": lambda t, geo, named: _expulsion(t, geo),
    "CAASPP": _assessments,
}
PLAIN: dict[str, Callable[[DataFrame, Geography], DataFrame]] = {
    "CGR": I.college_going_trend,
    "CENROLLMENT": _enrollment,
    "UPC": _pupil_counts,
    "SPED": lambda t, geo: I.special_education(t, geo, **SPED_CELL),
    "PFT": I.fitness_by_grade,
    "RECLASS": I.reclassification,
    "ELAS": I.language_status,
}
def missing_sources(sources: Mapping[str, DataFrame]) -> list[str]:
    """The sources that a whole report needs and these lack; their figures are not made."""
    return [name for name in [*LEVELED, *PLAIN, "CODEBOOK"] if sources.get(name) is None]


def figures(sources: Mapping[str, DataFrame], geo: Geography) -> list[DataFrame]:
    """Chart rows of all figures whose sources are at hand; without CODEBOOK some by-group charts are left out.

    Sources are named as the published tables are; SPED has a page per year (year, html).
    """
    present = {name: t for name, t in sources.items() if t is not None}
    book = present.get("CODEBOOK")
    out = []
    leveled = [make(present[name], geo, book is not None) for name, make in LEVELED.items() if name in present]
    if leveled:
        spark = leveled[0].sparkSession
        groups = [(GROUPS, code, name) for code, name in STUDENT_GROUPS]
        books = literal_table(spark, groups, "book string, code string, name string")
        if book is not None:
            listed = book.select(F.col("table").alias("book"), F.col("value").cast("string").alias("code"), F.col("definition").alias("name"))
            books = books.unionByName(listed.where(F.col("book").isin("SUSP", "CAASPP")))
        out.append(_leveled(stack(leveled), books))
    return out + [make(present[name], geo) for name, make in PLAIN.items() if name in present]


def write_report(
    sources: Mapping[str, DataFrame], geo: Geography, path: str, report_year: str, whole: bool = False
) -> None:
    """Write all figures of one edition under report_year=/figure=; a ``whole`` report refuses to lack a source."""
    lacking = missing_sources(sources)
    if whole and lacking:
        raise ValueError(f"sources that the report lacks: {', '.join(lacking)}")
    write_chart_rows(stack(figures(sources, geo)), path, report_year)


def trend_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-ins for all tables the report reads, from one stored panel."""
    rows = panel(spark, sf_dir)
    return {
        "GRAD_FOUR": S.grad_four(rows),
        "CGR": S.cgr(rows),
        "CENROLLMENT": S.cenrollment(rows),
        "SUSP": S.susp(rows),
        "EXP": S.exp(rows),
        "UPC": S.upc(rows),
        "SPED": S.sped_pages(spark, sf_dir),
        "PFT": S.pft(rows),
        "CAASPP": S.caaspp(rows),
        "RECLASS": S.reclass(rows),
        "ELAS": S.elas(rows),
        "CODEBOOK": S.codebook(spark),
    }


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the report over the derived sources."""
    return stack(figures(trend_sources(spark, sf_dir), FOCUS))
