"""Every operator and indicator as a query over the given tables.

Each entry is (spark, sf_dir) -> DataFrame and reads whole tables. Its SQL twin has the same
key in ``almanack.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions import (
    academic_year_label,
    bucket_of,
    category_family,
    comma_label,
    first_letter,
    group_name,
    guessed_types,
    is_total_or_blank,
    not_in,
    percent_label,
    per_thousand,
    place_name,
    recode,
    round_half_away,
    share,
    strip_separators,
    within_limits,
)
from almanack.operators import (
    alphabetical_order,
    append_series,
    at_latest,
    chain_latest,
    codebook_definitions,
    columns_between,
    columns_from,
    distinct_values,
    empty_like,
    first_by,
    first_seen_order,
    fixed_order,
    geo_column,
    group_names,
    group_sums,
    in_geography,
    lengthen,
    level_order,
    matches_any,
    measure_by_year,
    numbers_in,
    stack,
    sums_by_name,
    widen,
    widen_found,
    with_group_sums,
)
from almanack.plans import indicators as I
from almanack.plans import standins as S
from almanack.plans.panel import CATEGORIES, FOCUS, panel, read
from almanack.plans.report import report_rows
from almanack.sources import adopt_header, conform, html_cell, html_grid_cell, literal_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DISTRICTS = ["_4", "_19", "_24"]
CODE_NAMES = [("PARTSIZE", str(i), f"size {i}") for i in range(1, 31)] + [
    ("OTHER", str(i), "wrong table") for i in range(1, 51)
]
LITERAL_YEARS = ["1994-95", *S.YEARS, "2002-03"]
STATUS_NAMES = {"F": "Finished", "O": "Open"}


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


def exact(column: str) -> Column:
    """A money column as an exact decimal, so sums do not depend on row order."""
    return F.col(column).cast("decimal(18,4)")


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- Filters ----------------------------------------------------------------------------


@query("geo_trend_filter")
def geo_trend_filter(spark: SparkSession, sf: str) -> DataFrame:
    """State or focus county, all sentinels pinned, fraction per year."""
    df = panel(spark, sf).where(
        in_geography(FOCUS)
        & F.col("district_code").isNull()
        & (F.col("charter") == "All")
        & (F.col("reporting_category") == "TA")
    )
    return df.select(
        "academic_year",
        geo_column(FOCUS).alias("geo"),
        share("affected", "cumulative_enrollment").alias("rate"),
    )


def _dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("day")
    )


@query("latest_year_conjunct")
def latest_year_conjunct(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders of the newest day of all orders."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return at_latest(_dated_orders(spark, sf), "day", urgent)


@query("latest_year_chained")
def latest_year_chained(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders of the newest day of urgent orders."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return chain_latest(_dated_orders(spark, sf), "day", urgent)


@query("null_or_blank_filter")
def null_or_blank_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose drifting total column says All, is empty or is missing."""
    orders = read(spark, sf, "orders")
    total = (
        F.when(F.col("o_orderstatus") == "F", None)
        .when(F.col("o_orderstatus") == "P", "")
        .when(F.col("o_orderpriority") == "5-LOW", "All")
        .otherwise("N")
    )
    return (
        orders.withColumn("charter_yn", total)
        .where(is_total_or_blank("charter_yn"))
        .select("o_orderkey", "charter_yn", F.col("charter_yn").isNull().alias("is_missing"))
    )


@query("in_list_filter")
def in_list_filter(spark: SparkSession, sf: str) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    return (
        read(spark, sf, "orders")
        .withColumn("status", status)
        .where(F.col("status").isin("F", "X"))
        .select("o_orderkey", "status")
    )


@query("not_in_null_safe")
def not_in_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    return (
        read(spark, sf, "orders")
        .withColumn("status", status)
        .where(not_in("status", ["F", "X"]))
        .select("o_orderkey", "status")
    )


@query("regex_alternation_filter")
def regex_alternation_filter(spark: SparkSession, sf: str) -> DataFrame:
    return (
        read(spark, sf, "part")
        .where(matches_any("p_name", ["red", "blue"]) & F.col("p_brand").startswith("Brand#1"))
        .select("p_partkey", "p_name", "p_brand")
    )


@query("regex_negated_filter")
def regex_negated_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A NULL text neither matches nor fails to match, so it drops out."""
    kind = F.nullif("p_type", F.lit("LARGE"))
    return (
        read(spark, sf, "part")
        .withColumn("kind", kind)
        .where(~F.col("kind").rlike("ECO|SMA"))
        .select("p_partkey", "kind")
    )


@query("enrollment_floor_topn")
def enrollment_floor_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Suspension burden of districts above an enrollment floor, highest first."""
    return I.suspension_burden(_suspension_files(spark, sf), "TA", year="2000-01", floor=5)


@query("first_value_pull")
def first_value_pull(spark: SparkSession, sf: str) -> DataFrame:
    return first_by(read(spark, sf, "events"), "event_id", "event_id", "event_type", "value")


@query("axis_limit_censor")
def axis_limit_censor(spark: SparkSession, sf: str) -> DataFrame:
    rate = share("affected", "cumulative_enrollment")
    return panel(spark, sf).select(
        "academic_year",
        "aggregate_level",
        "county_code",
        "district_code",
        "charter",
        "reporting_category",
        rate.alias("y"),
        within_limits(rate, 0.3, 0.35).alias("y_visible"),
    )


# --- Joins and scalar functions ---------------------------------------------------------


@query("lookup_left_join")
def lookup_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Code list join; one segment has no code and keeps a NULL name."""
    known = {k: v for k, v in CATEGORIES.items() if k != "HOUSEHOLD"}
    df = read(spark, sf, "customer").select(
        "c_custkey", recode("c_mktsegment", known).alias("reporting_category")
    )
    return group_names(df)


@query("codebook_left_join")
def codebook_left_join(spark: SparkSession, sf: str) -> DataFrame:
    book = literal_table(spark, CODE_NAMES, "table string, value string, definition string")
    df = read(spark, sf, "part").select("p_partkey", "p_size")
    return codebook_definitions(df, book, "PARTSIZE", "p_size", "definition")


@query("category_family")
def category_family_of_code(spark: SparkSession, sf: str) -> DataFrame:
    """First letter of a code behind digits, and its family; some codes have no letter."""
    codes = {**CATEGORIES, "HOUSEHOLD": "TA", "FURNITURE": "-"}
    code = F.concat(F.col("c_nationkey").cast("string"), recode("c_mktsegment", codes))
    df = read(spark, sf, "customer").select("c_custkey", code.alias("code"))
    return df.select(
        "c_custkey",
        "code",
        first_letter("code").alias("letter"),
        category_family("code").alias("family"),
    )


@query("set_membership_bucket")
def set_membership_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(
        "p_partkey", "p_size", bucket_of("p_size", I.SUBGROUP_FAMILIES).alias("bucket")
    )


@query("recode_map")
def recode_map(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        "o_orderkey", recode("o_orderstatus", STATUS_NAMES).alias("status")
    )


@query("round_half_away")
def round_half_away_rows(spark: SparkSession, sf: str) -> DataFrame:
    amount = F.col("l_extendedprice") * F.col("l_discount")
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", round_half_away(amount, 2).alias("amount")
    )


@query("select_range_cast")
def select_range_cast(spark: SparkSession, sf: str) -> DataFrame:
    """A column range that arrives as text with suppressed cells."""
    df = read(spark, sf, "lineitem")
    measures = columns_between(df, "l_quantity", "l_tax")
    text = {
        c: F.when(F.col("l_linenumber") == 1, "*").otherwise(F.col(c).cast("string"))
        for c in measures
    }
    return numbers_in(df.withColumns(text), measures).select(
        "l_orderkey", "l_linenumber", *measures
    )


@query("coalesce_drift")
def coalesce_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A measure that was renamed: finished orders carry the old name only."""
    old = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    new = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    return read(spark, sf, "orders").select("o_orderkey", F.coalesce(new, old).alias("measure"))


@query("academic_year_label")
def academic_year_labels(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate")
    name = F.concat(F.lit("reclass"), F.lpad((year - 1985).cast("string"), 2, "0"), F.lit(".txt"))
    files = read(spark, sf, "orders").groupBy(name.alias("file")).agg(F.count("*").alias("n"))
    return files.select("file", academic_year_label("file").alias("label"), "n")


@query("normalise_geo_name")
def normalise_geo_name(spark: SparkSession, sf: str) -> DataFrame:
    """Tidy place and group names on every supplier and its region."""
    places = read(spark, sf, "nation").join(
        read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    df = read(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select("s_suppkey", place_name("r_name", "middle east").alias("geo"))


@query("normalise_group_name")
def normalise_group_name(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit("-"), F.lower("p_type"), F.lit(" (el) elm eo"))
    return read(spark, sf, "part").select("p_partkey", group_name(text).alias("group_name"))


def _pages_with_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every page followed by a table that gives its length with separators."""
    table = F.concat(
        F.lit("<center><table border='1'>\n<tr><th>Page</th><th>Length</th></tr>\n<tr><td>"),
        F.col("page_id").cast("string"),
        F.lit("</td><td align='right'><b>"),
        F.format_number(F.length("html"), 0),
        F.lit("</b>&nbsp;</td></tr></table></center>"),
    )
    return read(spark, sf, "pages").select("page_id", F.concat("html", table).alias("html"))


@query("html_nth_cell")
def html_nth_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Third item of the first list of every page, and a number from its table."""
    item = html_cell("html", row=1, cell=3, block_tag="ul", row_tag=None, cell_tag="li")
    return _pages_with_table(spark, sf).select(
        "page_id",
        item.alias("item"),
        strip_separators(html_cell("html", row=2, cell=2)).alias("number"),
    )


@query("html_grid_cell")
def html_grid_cell_of_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The published cell of a table whose cells span rows and columns, and the corner of its total."""
    return S.sped_pages(spark, sf).select(
        "year",
        html_grid_cell("html", row=22, column=15).alias("published"),
        html_grid_cell("html", row=22, column=2).alias("corner"),
    )


# --- Sums -------------------------------------------------------------------------------


@query("combined_rate")
def combined_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Several districts pooled: ratio of sums per year."""
    return I.district_pool(_suspension_files(spark, sf), FOCUS, DISTRICTS, "Pool")


@query("measure_by_year")
def measure_by_year_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return doubles(measure_by_year(orders, exact("o_totalprice"), "year"), "value")


@query("window_sum_distinct")
def window_sum_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Two sums per key, in long form; a sum with a missing input is missing."""
    line = read(spark, sf, "lineitem")
    known = F.when(F.col("l_returnflag") != "N", exact("l_extendedprice"))
    sums = sums_by_name(
        line, "l_returnflag", {"Quantity": exact("l_quantity"), "Price": known}
    )
    return doubles(sums, "value")


@query("group_total_on_rows")
def group_total_on_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every order with its customer's total."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    total = with_group_sums(orders, ["o_custkey"], {"customer_total": exact("o_totalprice")})
    return doubles(total, "customer_total")


@query("distinct_values")
def distinct_year_values(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_values(
        read(spark, sf, "orders").select(F.year("o_orderdate").alias("year")), "year"
    )


@query("cum_enrollment")
def cum_enrollment(spark: SparkSession, sf: str) -> DataFrame:
    return I.cumulative_enrollment(S.cenrollment(panel(spark, sf)), FOCUS, "SH", (5000, 14000))


@query("share_of_total")
def share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    return I.enrollment_share(S.cenrollment(panel(spark, sf)), FOCUS, "RB", (0.15, 0.2))


@query("rate_per_1000")
def rate_per_1000(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders per 1,000 per customer; a customer without finished orders has none."""
    per_customer = read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )
    return per_customer.select("o_custkey", per_thousand("pending", "finished").alias("rate"))


# --- Reshapes ---------------------------------------------------------------------------


def _by_flag(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    line = read(spark, sf, "lineitem")
    sums = group_sums(line, keys, {m: exact(m) for m in measures})
    return doubles(sums, *measures)


@query("pivot_multi_value")
def pivot_multi_value(spark: SparkSession, sf: str) -> DataFrame:
    by_flag = _by_flag(spark, sf, "l_returnflag", "l_linestatus")
    return widen(
        by_flag,
        ["l_returnflag"],
        "l_linestatus",
        ["F", "O"],
        ["l_quantity", "l_extendedprice"],
    ).drop("l_extendedprice_F")


@query("pivot_found_names")
def pivot_found_names(spark: SparkSession, sf: str) -> DataFrame:
    """A column per day of the week that occurs, found in the data; one row per customer segment."""
    orders = read(spark, sf, "orders").join(
        read(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    counts = orders.groupBy("c_mktsegment", F.weekday("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    return widen_found(counts, ["c_mktsegment"], "day", ["n"])


@query("select_prefix_unpivot")
def select_prefix_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """Columns found by prefix, whatever its case, lengthened with their NULLs."""
    scores = read(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_discount").alias("Percentage Met.19"),
        F.when(F.col("l_returnflag") == "N", F.col("l_tax")).alias("Percentage Met.18"),
        F.col("l_quantity").alias("Count"),
    )
    scores, years = I.years_from_suffix(scores, columns_from(scores, "percentage met"))
    return lengthen(scores, years, ["l_orderkey", "l_linenumber"], name="year")


@query("gather_except")
def gather_except(spark: SparkSession, sf: str) -> DataFrame:
    return lengthen(_by_flag(spark, sf, "l_suppkey"), None, ["l_suppkey"])


# --- Orders -----------------------------------------------------------------------------


@query("order_by_median")
def order_by_median(spark: SparkSession, sf: str) -> DataFrame:
    return level_order(read(spark, sf, "part"), "p_brand", "p_retailprice", "median")


@query("order_by_mean")
def order_by_mean(spark: SparkSession, sf: str) -> DataFrame:
    levels = level_order(read(spark, sf, "part"), "p_brand", "p_retailprice", "mean")
    return levels.withColumn("mean", F.round("mean", 6))  # the digits that no order of rows changes


@query("fixed_order")
def fixed_front_order(spark: SparkSession, sf: str) -> DataFrame:
    return fixed_order(read(spark, sf, "orders"), "o_orderpriority", ["3-MEDIUM", "1-URGENT"])


@query("fixed_before_first_seen")
def fixed_before_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Named labels in front, all others in the order they were first seen in."""
    events = read(spark, sf, "events")
    seen = first_seen_order(events, "event_type", "event_id")
    return fixed_order(events, "event_type", ["view", "signup"], seen)


@query("first_seen_order")
def first_seen_types(spark: SparkSession, sf: str) -> DataFrame:
    return first_seen_order(read(spark, sf, "events"), "event_type", "event_id")


@query("alphabetical_levels")
def alphabetical_levels(spark: SparkSession, sf: str) -> DataFrame:
    return alphabetical_order(read(spark, sf, "part"), "p_type")


# --- Unions, headers, files -------------------------------------------------------------


def _suspension_files(spark: SparkSession, sf: str) -> DataFrame:
    return stack([conform(f) for f in S.susp_files(panel(spark, sf))])


@query("ingest_union_drift")
def ingest_union_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of files under different headers, united, drift merged, filtered."""
    orders = read(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    early = orders.where(day < "1998-01-01").select(
        F.col("o_orderkey").alias("Order Key"),
        F.when(F.col("o_orderpriority") == "5-LOW", "N").otherwise("Y").alias("CharterYN"),
        F.col("o_totalprice").alias("Price (Old)"),
    )
    late = orders.where(F.coalesce(day >= "1998-01-01", F.lit(True))).select(
        F.col("o_totalprice").alias("price % new"),
        F.when(F.col("o_orderpriority") == "5-LOW", "No ").otherwise("Y").alias("CharterYn"),
        F.col("o_orderkey").alias("order-key"),
    )
    united = stack([conform(early), conform(late)])
    return united.where(F.trim("CharterYn").isin("N", "No")).select(
        "OrderKey", F.coalesce("PricePercentNew", "PriceOld").alias("Price")
    )


def _by_status(orders: DataFrame) -> list[DataFrame]:
    """Orders split by status; every other status, and none, makes up the last part."""
    status = F.col("o_orderstatus")
    rest = ~F.coalesce(status.isin("F", "O"), F.lit(False))
    return [orders.where(status == "F"), orders.where(status == "O"), orders.where(rest)]


def _yearly_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a text file would give them: some years suppress a price, one has no day."""
    orders = read(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    small = (F.col("year") < 1997) & (F.col("o_totalprice") < 50_000)
    return orders.select(
        "year",
        F.col("o_orderkey").cast("string").alias("key"),
        F.when(small, "*").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("year") != 1999, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("o_orderstatus") == "O", "TRUE").otherwise("FALSE").alias("open"),
        F.when(F.col("o_orderstatus") == "P", "NA").alias("gone"),
    )


@query("guessed_types")
def guessed_type_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each text column holds in each year."""
    report = guessed_types(_yearly_texts(spark, sf), ["year"], ["key", "price", "day", "open", "gone"])
    return report.select("year", "column", "type", "filled")


@query("union_unlike_types")
def union_unlike_types(spark: SparkSession, sf: str) -> DataFrame:
    """Years of numbers and years of text under one name: the union is text."""
    orders = read(spark, sf, "orders")
    late = F.year("o_orderdate") >= 1997
    numbers = orders.where(late).select("o_orderkey", F.col("o_orderkey").cast("double").alias("value"))
    texts = orders.where(F.coalesce(~late, F.lit(True))).select("o_orderkey", F.col("o_orderstatus").alias("value"))
    return stack([numbers, texts])


@query("positional_rename_union")
def positional_rename_union(spark: SparkSession, sf: str) -> DataFrame:
    """Later frames take the first frame's header by position."""
    first, *others = _by_status(read(spark, sf, "orders"))
    first = first.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    later = [df.select("o_orderkey", "o_totalprice") for df in others]
    return stack([first, *[adopt_header(df, first.columns) for df in later]])


@query("empty_seed_union")
def empty_seed_union(spark: SparkSession, sf: str) -> DataFrame:
    """Accumulation that starts from a frame without rows."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    acc = empty_like(orders)
    for part in _by_status(orders):
        acc = stack([acc, part])
    return acc


@query("file_provenance")
def file_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """Rows tagged with the file they came from, counted per file."""
    source = F.regexp_extract("_metadata.file_path", r"([^/]+\.parquet)(/|$)", 1)
    tagged = [
        read(spark, sf, name).select(source.alias("file"), F.col(balance).alias("balance"))
        for name, balance in (("customer", "c_acctbal"), ("supplier", "s_acctbal"))
    ]
    return doubles(
        stack(tagged)
        .groupBy("file")
        .agg(F.count("*").alias("n"), F.sum(exact("balance")).alias("balance")),
        "balance",
    )


@query("append_series")
def append_pooled_series(spark: SparkSession, sf: str) -> DataFrame:
    pool = I.district_pool(_suspension_files(spark, sf), FOCUS, DISTRICTS, "Pool")
    sheet = S.foster(panel(spark, sf)).select("Year", "Geo", F.col("Rate").alias("Value"))
    return append_series(sheet, pool, {"Year": "academic_year", "Value": "rate", "Geo": "geo"})


@query("literal_series")
def literal_series(spark: SparkSession, sf: str) -> DataFrame:
    """A written-out list of years, each with its count; years without data stay."""
    years = literal_table(spark, [(y,) for y in LITERAL_YEARS], "year string")
    upc = S.upc(panel(spark, sf))
    values = measure_by_year(upc, "total_enrollment")
    return years.join(values, "year", "left")


@query("report_table_formatted")
def report_table_formatted(spark: SparkSession, sf: str) -> DataFrame:
    rate = share("affected", "cumulative_enrollment")
    return panel(spark, sf).select(
        "academic_year",
        "county_name",
        "district_code",
        "charter",
        "reporting_category",
        comma_label(F.col("cumulative_enrollment") * 1000).alias("people"),
        percent_label(rate, 1).alias("rate_0"),
        percent_label(rate, 0.1).alias("rate_1"),
        percent_label(rate, 0.01).alias("rate_2"),
    )


# --- Indicators -------------------------------------------------------------------------


@query("graduation_trend")
def graduation_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.graduation_trend(S.grad_four(panel(spark, sf)), FOCUS)


@query("graduation_trend_labels")
def graduation_trend_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled points of the trend chart."""
    return I.label_layer(I.graduation_trend(S.grad_four(panel(spark, sf)), FOCUS))


@query("graduation_by_group")
def graduation_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.graduation_by_group(S.grad_four(panel(spark, sf)), FOCUS, S.codebook(spark))


@query("college_going_trend")
def college_going_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.college_going_trend(S.cgr(panel(spark, sf)), FOCUS)


@query("dropout_trend")
def dropout_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.dropout_trend(S.grad_four(panel(spark, sf)), FOCUS)


@query("dropout_by_group")
def dropout_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.dropout_by_group(S.grad_four(panel(spark, sf)), FOCUS, S.codebook(spark))


@query("pupil_counts")
def pupil_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All four count columns of the pupil count table."""
    upc = S.upc(panel(spark, sf))
    limits = {
        "total_enrollment": (60000, 80000),
        "homeless": (0, 10000),
        "unduplicated_frpm_eligible_count": (50000, 60000),
        "english_learner_el": (25000, 35000),
    }
    return stack([I.pupil_count(upc, FOCUS, m, lim) for m, lim in limits.items()])


@query("special_education_cells")
def special_education_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One table cell per page; the page number stands for the year."""
    pages = _pages_with_table(spark, sf).withColumnRenamed("page_id", "year")
    return I.special_education(pages, FOCUS, row=2, cell=2)


@query("suspension_trend")
def suspension_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.suspension_trend(S.susp(panel(spark, sf)), FOCUS)


@query("suspension_by_group")
def suspension_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.suspension_by_group(S.susp(panel(spark, sf)), FOCUS)


@query("expulsion_trend")
def expulsion_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.expulsion_trend(S.exp(panel(spark, sf)), FOCUS)


@query("expulsion_by_group")
def expulsion_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.expulsion_by_group(S.exp(panel(spark, sf)), FOCUS)


@query("fitness_by_grade")
def fitness_by_grade(spark: SparkSession, sf: str) -> DataFrame:
    return I.fitness_by_grade(S.pft(panel(spark, sf)), FOCUS)


@query("assessment_trend")
def assessment_trend(spark: SparkSession, sf: str) -> DataFrame:
    caaspp = S.caaspp(panel(spark, sf))
    return stack([I.assessment_trend(caaspp, FOCUS, test) for test in (1, 2)])


@query("assessment_by_group")
def assessment_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.assessment_by_group(S.caaspp(panel(spark, sf)), FOCUS, S.codebook(spark), 1)


@query("assessment_wide_trend")
def assessment_wide_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.assessment_wide_trend(S.caaspp_wide(panel(spark, sf)), FOCUS, "Math")


@query("assessment_wide_by_group")
def assessment_wide_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.assessment_wide_by_group(S.caaspp_wide(panel(spark, sf)), FOCUS, "ELA")


@query("reclassification")
def reclassification(spark: SparkSession, sf: str) -> DataFrame:
    return I.reclassification(S.reclass(panel(spark, sf)), FOCUS)


@query("reclassification_files")
def reclassification_files(spark: SparkSession, sf: str) -> DataFrame:
    return I.reclassification(S.reclass(panel(spark, sf)), FOCUS, source="files")


@query("language_status")
def language_status(spark: SparkSession, sf: str) -> DataFrame:
    return I.language_status(S.elas(panel(spark, sf)), FOCUS)


@query("suspension_burden_district")
def suspension_burden_district(spark: SparkSession, sf: str) -> DataFrame:
    """One district over the years, whatever the school code."""
    files = _suspension_files(spark, sf)
    return I.suspension_burden(files, "TA", district="00005", school_totals=False)


@query("suspension_burden_group")
def suspension_burden_group(spark: SparkSession, sf: str) -> DataFrame:
    """One group of one district."""
    return I.suspension_burden(_suspension_files(spark, sf), "RB", district="00005")


@query("demographics_by_group")
def demographics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.sheet_by_group(S.demographics(panel(spark, sf)), "demographics", "middle east")


@query("personnel_ratio")
def personnel_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return I.personnel(S.personnel_sheet(panel(spark, sf)))


@query("foster_trend")
def foster_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.sheet_trend(S.foster(panel(spark, sf)), "foster_trend", "rate", 0.01, (0, 0.0035))


@query("homeless_trend")
def homeless_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.sheet_trend(S.rate_sheet(panel(spark, sf), "affected", 10), "homeless_trend", "value", 0.1, (0, 0.1))


@query("graduation_sheet_trend")
def graduation_sheet_trend(spark: SparkSession, sf: str) -> DataFrame:
    return I.sheet_trend(S.rate_sheet(panel(spark, sf), "affected", 1), "graduation_sheet_trend", "value", 1)


@query("suspension_sheet_trend")
def suspension_sheet_trend(spark: SparkSession, sf: str) -> DataFrame:
    sheet = S.rate_sheet(panel(spark, sf), "pending", 1)
    return I.sheet_trend(sheet, "suspension_sheet_trend", "value", 0.1, (0.03, 0.07))


@query("expulsion_sheet_trend")
def expulsion_sheet_trend(spark: SparkSession, sf: str) -> DataFrame:
    sheet = S.rate_sheet(panel(spark, sf), "pending", 20)
    return I.sheet_trend(sheet, "expulsion_sheet_trend", "value", 0.01, (0, 0.002))


@query("graduation_sheet_by_group")
def graduation_sheet_by_group(spark: SparkSession, sf: str) -> DataFrame:
    sheet = S.graduation_sheet(panel(spark, sf))
    return I.sheet_by_group(sheet, "graduation_sheet_by_group", "middle east", group="subgroup")


@query("assessment_sheet_by_group")
def assessment_sheet_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return I.assessment_sheet_by_group(S.ela_sheet(panel(spark, sf)), "middle east", "ELA", "2001-02")


@query("assessment_sheet_by_grade")
def assessment_sheet_by_grade(spark: SparkSession, sf: str) -> DataFrame:
    return I.assessment_sheet_by_grade(
        S.ela_sheet(panel(spark, sf)), "middle east", "Math", "Middle East County", (0.2, 0.35)
    )


@query("assessment_table")
def assessment_table(spark: SparkSession, sf: str) -> DataFrame:
    sheet = S.ela_sheet(panel(spark, sf))
    return I.assessment_table(sheet, [c for c in sheet.columns if c[:1].isdigit()], "Math")


@query("suspension_frame")
def suspension_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Totals from two generations of files, with the renamed measure merged."""
    new = "suspension_count_of_students_suspended_defiance_only"
    df = I.discipline_frame(
        _suspension_files(spark, sf),
        FOCUS,
        ["cumulative_enrollment", "total_suspensions"],
        either=("suspension_count_defiance_only", new),
    )
    return df.select(
        "academic_year", "geo", "charter_yn", "cumulative_enrollment", "total_suspensions", f"{new}2"
    )


@query("expulsion_frame")
def expulsion_frame(spark: SparkSession, sf: str) -> DataFrame:
    """County and state totals with the expelled proportion."""
    part = "unduplicated_count_of_students_expelled_total"
    df = I.discipline_frame(S.exp(panel(spark, sf)), FOCUS, ["cumulative_enrollment", part])
    return df.select(
        "academic_year",
        "geo",
        "charter_yn",
        F.try_divide(part, "cumulative_enrollment").alias("rate"),
    )


@query("report_chart_rows")
def report_chart_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All figures of the report in one frame."""
    return report_rows(spark, sf)
