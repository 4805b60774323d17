"""The queries of ``almanack.plans.catalog`` in plain SQL, for a result check in DuckDB.

Written from the definitions, not from the Spark plans. Sums of money go through decimals
and rates are single divisions of whole numbers, so both engines yield the same doubles.
"""

from __future__ import annotations

import re

from almanack.plans import standins as S
from almanack.plans.catalog import CODE_NAMES, DISTRICTS, LITERAL_YEARS
from almanack.plans.indicators import SUBGROUP_FAMILIES
from almanack.plans.panel import CATEGORIES, FOCUS
from almanack.sources import STUDENT_GROUPS

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple[object, ...]]) -> str:
    cell = lambda v: _text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _case(column: str, mapping: dict[str, object]) -> str:
    cell = lambda v: _text(v) if isinstance(v, str) else str(v)
    arms = " ".join(f"WHEN {_text(k)} THEN {cell(v)}" for k, v in mapping.items())
    return f"(CASE {column} {arms} END)"


def _percent(x: str, digits: int) -> str:
    steps = f"CAST(round_even(({x}) / {('1e-2', '1e-3', '1e-4')[digits]}, 0) AS BIGINT)"
    unit = 10**digits
    tail = f" || '.' || lpad(CAST(abs({steps}) % {unit} AS VARCHAR), {digits}, '0')" if digits else ""
    return (
        f"((CASE WHEN {steps} < 0 THEN '-' ELSE '' END) || "
        f"CAST(abs({steps}) // {unit} AS VARCHAR){tail} || '%')"
    )


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT))"


def _half_away(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(sign({x}) * floor(abs({x}) * {scale} + 0.5) / {scale})"


def _title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}''’]+|[^\\p{{L}}\\p{{N}}''’]')"
    return (
        f"array_to_string(list_transform({runs}, "
        "lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), '')"
    )


def _number(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


# --- The panel and the source tables derived from it ------------------------------------

_PLACES = [[], ["r_regionkey", "r_name"], ["r_regionkey", "r_name", "n_nationkey", "n_name"]]
_SETS = ", ".join(
    "(" + ", ".join(["yr", *place, *category, *charter]) + ")"
    for place in _PLACES
    for category in ([], ["c_mktsegment"])
    for charter in ([], ["ch"])
)
PANEL = f"""
facts AS (
  SELECT year(o_orderdate) AS yr, r_regionkey, r_name, n_nationkey, n_name, c_mktsegment,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' ELSE 'N' END AS ch,
         o_orderstatus AS st
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
rolled AS (
  SELECT yr, r_regionkey, r_name, n_nationkey, n_name, c_mktsegment, ch,
         grouping(r_regionkey) AS no_county, grouping(n_nationkey) AS no_district,
         grouping(c_mktsegment) AS no_category, grouping(ch) AS no_charter,
         count(*) AS ce, count(*) FILTER (st = 'F') AS affected,
         count(*) FILTER (st = 'P') AS pending
  FROM facts GROUP BY GROUPING SETS ({_SETS})
),
panel AS (
  SELECT CAST(yr AS VARCHAR) || '-' || lpad(CAST((yr + 1) % 100 AS VARCHAR), 2, '0') AS academic_year,
         CAST(yr AS INTEGER) AS yr,
         CASE WHEN no_county = 1 THEN 'T' WHEN no_district = 1 THEN 'C'
              WHEN n_nationkey % 2 = 0 THEN 'D1' ELSE 'D2' END AS aggregate_level,
         CASE WHEN no_county = 1 THEN '00'
              ELSE lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') END AS county_code,
         CASE WHEN no_county = 1 THEN 'State' ELSE r_name END AS county_name,
         CASE WHEN no_district = 0 THEN lpad(CAST(n_nationkey + 1 AS VARCHAR), 5, '0') END AS district_code,
         CASE WHEN no_district = 0 THEN n_name END AS district_name,
         CASE WHEN no_charter = 1 THEN 'All' ELSE ch END AS charter,
         CASE WHEN no_category = 1 THEN 'TA' ELSE {_case('c_mktsegment', CATEGORIES)} END AS cat,
         ce, affected, pending
  FROM rolled
)"""

_WHOLE = "district_code IS NULL AND charter = 'All'"
_TREND = f"(aggregate_level = 'T' OR county_code = '{FOCUS.county_code}') AND cat = 'TA' AND {_WHOLE}"
_GEO = f"(CASE WHEN aggregate_level = 'T' THEN '{FOCUS.state_name}' ELSE county_name END)"
_FAMILY = (
    "(CASE substring(cat, 1, 1) WHEN 'G' THEN 'Gender' WHEN 'R' THEN 'Race/Ethnicity' "
    "WHEN 'S' THEN 'Student Group' END)"
)
_NAMES = f"names(cat, student_group) AS (VALUES {_values(STUDENT_GROUPS)})"
_BOOK_NAMES = f"names(cat, student_group) AS (VALUES {_values([r for r in STUDENT_GROUPS if r[0] != 'RA'])})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _chart(
    figure: str,
    x: str,
    y: str,
    source: str,
    series: str = "NULL",
    label: str = "NULL",
    facet: str = "NULL",
    level: str = "NULL",
    limits: tuple[float, float] | None = None,
) -> str:
    shown = f"CASE WHEN y BETWEEN {limits[0]} AND {limits[1]} THEN y END" if limits else "y"
    return f"""
SELECT {_text(figure)} AS figure, CAST(series AS VARCHAR) AS series, CAST(x AS VARCHAR) AS x, y,
       {shown} AS y_visible, CAST(label AS VARCHAR) AS label, CAST(facet AS VARCHAR) AS facet,
       CAST(lvl AS INTEGER) AS level
FROM (SELECT {series} AS series, {x} AS x, CAST({y} AS DOUBLE) AS y, {label} AS label,
             {facet} AS facet, {level} AS lvl FROM {source})"""


def _ranked(frame: str, name: str, stat: str) -> str:
    """A level per name: by statistic, then name; NULL names last."""
    return f"""
ranked AS (SELECT {name} AS lname, row_number() OVER (
             ORDER BY ({name} IS NULL), stat ASC NULLS LAST, {name}) AS lvl
           FROM (SELECT {name}, {stat} AS stat FROM {frame} GROUP BY {name}))"""


# --- Filters ----------------------------------------------------------------------------

ORACLES["geo_trend_filter"] = _with(PANEL) + f"""
SELECT academic_year, {_GEO} AS geo, affected / ce AS rate FROM panel WHERE {_TREND}"""

ORACLES["latest_year_conjunct"] = """
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderpriority = '1-URGENT'
  AND CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)"""

ORACLES["latest_year_chained"] = """
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders
WHERE o_orderpriority = '1-URGENT'
  AND CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders
                                   WHERE o_orderpriority = '1-URGENT')"""

ORACLES["null_or_blank_filter"] = """
SELECT o_orderkey, charter_yn, charter_yn IS NULL AS is_missing FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN ''
                          WHEN o_orderpriority = '5-LOW' THEN 'All' ELSE 'N' END AS charter_yn
  FROM orders)
WHERE charter_yn = 'All' OR charter_yn IS NULL OR charter_yn = ''"""

ORACLES["in_list_filter"] = """
SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'"""

ORACLES["not_in_null_safe"] = """
SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status FROM orders
WHERE NOT coalesce(nullif(o_orderstatus, 'P') IN ('F', 'X'), false)"""

ORACLES["regex_alternation_filter"] = """
SELECT p_partkey, p_name, p_brand FROM part
WHERE regexp_matches(p_name, 'red|blue') AND starts_with(p_brand, 'Brand#1')"""

ORACLES["regex_negated_filter"] = """
SELECT p_partkey, p_type AS kind FROM part
WHERE p_type <> 'LARGE' AND NOT regexp_matches(p_type, 'ECO|SMA')"""

ORACLES["first_value_pull"] = """
SELECT event_id, event_type, value FROM events
WHERE event_id = (SELECT min(event_id) FROM events)"""

ORACLES["axis_limit_censor"] = _with(PANEL) + """
SELECT academic_year, aggregate_level, county_code, district_code, charter,
       cat AS reporting_category, affected / ce AS y,
       CASE WHEN affected / ce BETWEEN 0.3 AND 0.35 THEN affected / ce END AS y_visible
FROM panel"""

# --- Joins and scalar functions ---------------------------------------------------------

_KNOWN = {k: v for k, v in CATEGORIES.items() if k != "HOUSEHOLD"}
ORACLES["lookup_left_join"] = _with(_NAMES) + f"""
SELECT reporting_category, c_custkey, student_group FROM (
  SELECT c_custkey, coalesce({_case('c_mktsegment', _KNOWN)}, c_mktsegment) AS reporting_category
  FROM customer) LEFT JOIN names ON reporting_category = cat"""

ORACLES["codebook_left_join"] = f"""
WITH book(tab, value, definition) AS (VALUES {_values(CODE_NAMES)})
SELECT p_partkey, p_size, definition FROM part
LEFT JOIN book ON tab = 'PARTSIZE' AND value = CAST(p_size AS VARCHAR)"""

_CODES = {**CATEGORIES, "HOUSEHOLD": "TA", "FURNITURE": "-"}
ORACLES["category_family"] = f"""
SELECT c_custkey, code, letter,
       CASE letter WHEN 'G' THEN 'Gender' WHEN 'R' THEN 'Race/Ethnicity'
                   WHEN 'S' THEN 'Student Group' END AS family
FROM (SELECT *, nullif(regexp_extract(code, '[[:alpha:]]'), '') AS letter FROM (
  SELECT c_custkey, CAST(c_nationkey AS VARCHAR) || {_case('c_mktsegment', _CODES)} AS code
  FROM customer))"""

_BUCKETS = " ".join(
    f"WHEN p_size IN ({', '.join(map(str, ids))}) THEN {_text(name)}"
    for name, ids in SUBGROUP_FAMILIES.items()
)
ORACLES["set_membership_bucket"] = f"""
SELECT p_partkey, p_size, CASE {_BUCKETS} END AS bucket FROM part"""

ORACLES["recode_map"] = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open'
                   ELSE o_orderstatus END AS status FROM orders"""

ORACLES["round_half_away"] = f"""
SELECT l_orderkey, l_linenumber, {_half_away('(l_extendedprice * l_discount)', 2)} AS amount
FROM lineitem"""

ORACLES["select_range_cast"] = "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"TRY_CAST(CASE WHEN l_linenumber = 1 THEN '*' ELSE CAST({c} AS VARCHAR) END AS DOUBLE) AS {c}"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
) + " FROM lineitem"

ORACLES["coalesce_drift"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice END AS measure
FROM orders"""

ORACLES["academic_year_label"] = """
SELECT 'reclass' || lpad(CAST(yy AS VARCHAR), 2, '0') || '.txt' AS file,
       '20' || lpad(CAST(yy - 1 AS VARCHAR), 2, '0') || '-20' || lpad(CAST(yy AS VARCHAR), 2, '0') AS label,
       count(*) AS n
FROM (SELECT year(o_orderdate) - 1985 AS yy FROM orders) GROUP BY yy"""

_REGION_NAME = "replace(replace(lower(r_name), 'middle east', 'middle east county'), 'county county', 'county')"
ORACLES["normalise_geo_name"] = f"""
SELECT s_suppkey, {_title(_REGION_NAME)} AS geo
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

_GROUP_NAME = _title("(p_name || '-' || lower(p_type) || ' (el) elm eo')")
ORACLES["normalise_group_name"] = f"""
SELECT p_partkey, regexp_replace(regexp_replace({_GROUP_NAME}, '\\bEo\\b', 'EO', 'g'),
                                 '\\bEl\\b', 'ELs', 'g') AS group_name FROM part"""


def _list_cell(n: int) -> str:
    block = r"regexp_extract_all(html, '(?is)<(?:ul)(?:\s[^>]*)?>(.*?)</(?:ul)>', 1)[1]"
    cell = rf"regexp_extract_all({block}, '(?is)<(?:li)(?:\s[^>]*)?>(.*?)</(?:li)>', 1)[{n}]"
    text = rf"regexp_replace({cell}, '(?s)<[^>]*>', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim({text}, ' ')"


ORACLES["html_nth_cell"] = f"""
SELECT page_id, {_list_cell(3)} AS item, CAST(length(html) AS DOUBLE) AS number FROM pages"""

ORACLES["html_grid_cell"] = """
SELECT page_id AS year, format('{:,}', length(html)) AS published, 'Total' AS corner FROM pages"""

# --- Sums -------------------------------------------------------------------------------


def _dsum(column: str, where: str = "true") -> str:
    """A sum that is NULL if one of its inputs is."""
    total = f"CAST(sum(CAST({column} AS DECIMAL(18,4))) FILTER ({where}) AS DOUBLE)"
    complete = f"count({column}) FILTER ({where}) = count(*) FILTER ({where})"
    return f"(CASE WHEN {complete} THEN {total} END)"


_ANY_DISTRICT = f"regexp_matches(district_name, '{'|'.join(DISTRICTS)}')"
_POOL = f"""
pool AS (
  SELECT academic_year, county_code, CAST(sum(ce) AS DOUBLE) AS people,
         CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS DOUBLE) END AS suspended
  FROM (SELECT *, CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN pending END AS n FROM panel)
  WHERE aggregate_level IN ('D1', 'D2') AND county_code = '{FOCUS.county_code}'
    AND {_ANY_DISTRICT} AND cat = 'TA'
  GROUP BY academic_year, county_code)"""
ORACLES["combined_rate"] = _with(PANEL, _POOL) + """
SELECT academic_year, county_code, people AS cumulative_enrollment,
       suspended AS unduplicated_count_of_students_suspended_total,
       suspended / people AS rate, 'Pool' AS geo FROM pool"""

ORACLES["measure_by_year"] = """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
       CASE WHEN count(o_totalprice) = count(*)
            THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) END AS value
FROM orders GROUP BY 1"""

ORACLES["window_sum_distinct"] = f"""
WITH sums AS (
  SELECT l_returnflag, {_dsum('l_quantity')} AS "Quantity",
         CASE WHEN l_returnflag <> 'N' THEN {_dsum('l_extendedprice')} END AS "Price"
  FROM lineitem GROUP BY l_returnflag)
SELECT * FROM sums UNPIVOT INCLUDE NULLS (value FOR name IN ("Quantity", "Price"))"""

ORACLES["group_total_on_rows"] = """
SELECT o_orderkey, o_custkey, o_totalprice,
       CASE WHEN count(o_totalprice) OVER (PARTITION BY o_custkey) = count(*) OVER (PARTITION BY o_custkey)
            THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE)
       END AS customer_total
FROM orders"""

ORACLES["distinct_values"] = """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"""

ORACLES["rate_per_1000"] = """
SELECT o_custkey, CAST(1000 * count(*) FILTER (o_orderstatus = 'P') AS DOUBLE)
                  / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS rate
FROM orders GROUP BY o_custkey"""

# --- Reshapes ---------------------------------------------------------------------------


ORACLES["pivot_multi_value"] = f"""
SELECT l_returnflag, {_dsum('l_quantity', "l_linestatus = 'F'")} AS "l_quantity_F",
       {_dsum('l_quantity', "l_linestatus = 'O'")} AS "l_quantity_O",
       {_dsum('l_extendedprice', "l_linestatus = 'O'")} AS "l_extendedprice_O"
FROM lineitem GROUP BY l_returnflag"""

ORACLES["pivot_found_names"] = "SELECT c_mktsegment, " + ", ".join(
    f"nullif(count(*) FILTER (isodow(o_orderdate) = {day + 1}), 0) AS n_{day}" for day in range(7)
) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"

ORACLES["select_prefix_unpivot"] = """
SELECT l_orderkey, l_linenumber, l_discount AS value, '2018-19' AS year FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN l_tax END, '2017-18' FROM lineitem"""

_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORACLES["gather_except"] = f"""
WITH sums AS (SELECT l_suppkey, {', '.join(f'{_dsum(m)} AS {m}' for m in _MEASURES)}
              FROM lineitem GROUP BY l_suppkey)
SELECT * FROM sums UNPIVOT INCLUDE NULLS (value FOR name IN ({', '.join(_MEASURES)}))"""

# --- Orders -----------------------------------------------------------------------------

ORACLES["order_by_median"] = """
SELECT p_brand, median, CAST(row_number() OVER (
         ORDER BY (p_brand IS NULL), median NULLS LAST, p_brand) AS INTEGER) AS level
FROM (SELECT p_brand, median(p_retailprice) AS median FROM part GROUP BY p_brand)"""

ORACLES["order_by_mean"] = """
SELECT p_brand, round(mean, 6) AS mean, CAST(row_number() OVER (
         ORDER BY (p_brand IS NULL), mean NULLS LAST, p_brand) AS INTEGER) AS level
FROM (SELECT p_brand, avg(p_retailprice) AS mean
      FROM part GROUP BY p_brand)"""

ORACLES["fixed_order"] = """
SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY CASE o_orderpriority
         WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderpriority) AS INTEGER) AS level
FROM (SELECT DISTINCT o_orderpriority FROM orders)"""

ORACLES["fixed_before_first_seen"] = """
SELECT event_type, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END,
                                           first_seen) AS INTEGER) AS level
FROM (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type)"""

ORACLES["first_seen_order"] = """
SELECT event_type, first_seen, CAST(row_number() OVER (ORDER BY first_seen) AS INTEGER) AS level
FROM (SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type)"""

ORACLES["alphabetical_levels"] = """
SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS level
FROM (SELECT DISTINCT p_type FROM part)"""

# --- Unions, headers, files -------------------------------------------------------------

ORACLES["ingest_union_drift"] = """
SELECT o_orderkey AS "OrderKey", o_totalprice AS "Price" FROM orders
WHERE o_orderpriority = '5-LOW'"""

_TEXT_YEARS = """
texts AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey AS VARCHAR) AS key,
         CASE WHEN year(o_orderdate) < 1997 AND o_totalprice < 50000 THEN '*' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
         CASE WHEN year(o_orderdate) <> 1999 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
         CASE o_orderstatus WHEN 'O' THEN 'TRUE' ELSE 'FALSE' END AS open,
         CASE o_orderstatus WHEN 'P' THEN 'NA' END AS gone
  FROM orders
), cells AS (
  SELECT year, 'key' AS col, key AS cell FROM texts UNION ALL SELECT year, 'price', price FROM texts
  UNION ALL SELECT year, 'day', day FROM texts UNION ALL SELECT year, 'open', open FROM texts
  UNION ALL SELECT year, 'gone', gone FROM texts
)"""
ORACLES["guessed_types"] = _with(_TEXT_YEARS) + """
SELECT year, col AS "column", CASE
         WHEN count(cell) = 0 THEN 'empty'
         WHEN bool_and(cell IN ('TRUE', 'FALSE')) THEN 'logical'
         WHEN bool_and(TRY_CAST(cell AS DOUBLE) IS NOT NULL) THEN 'number'
         WHEN bool_and(TRY_CAST(cell AS DATE) IS NOT NULL) THEN 'date'
         ELSE 'text' END AS type, count(cell) AS filled
FROM cells GROUP BY year, col"""

ORACLES["union_unlike_types"] = """
SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1997 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS value
FROM orders"""

ORACLES["positional_rename_union"] = """
SELECT o_orderkey AS key, o_totalprice AS price FROM orders"""

ORACLES["empty_seed_union"] = """
SELECT o_orderkey, o_orderstatus FROM orders"""

ORACLES["file_provenance"] = """
SELECT 'customer.parquet' AS file, count(*) AS n,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer
UNION ALL
SELECT 'supplier.parquet', count(*), CAST(sum(CAST(s_acctbal AS DECIMAL(18,4))) AS DOUBLE)
FROM supplier"""

_FOSTER = """
foster AS (SELECT academic_year, county_name, pending, CAST(pending AS DOUBLE) / (ce * 100) AS rate
           FROM panel WHERE aggregate_level IN ('T', 'C') AND charter = 'All' AND cat = 'SH')"""
ORACLES["append_series"] = _with(PANEL, _POOL, _FOSTER) + """
SELECT academic_year AS "Year", county_name AS "Geo", rate AS "Value" FROM foster
UNION ALL SELECT academic_year, 'Pool', suspended / people FROM pool"""

ORACLES["literal_series"] = _with(PANEL) + f"""
SELECT year, value FROM (VALUES {_values([(y,) for y in LITERAL_YEARS])}) AS years(year)
LEFT JOIN (SELECT academic_year, CAST(sum(ce) AS BIGINT) AS value FROM panel
           WHERE district_code IS NOT NULL AND charter = 'All' AND cat = 'TA'
           GROUP BY academic_year) ON year = academic_year"""

ORACLES["report_table_formatted"] = _with(PANEL) + f"""
SELECT academic_year, county_name, district_code, charter, cat AS reporting_category,
       {_comma('ce * 1000')} AS people, {_percent('affected / ce', 0)} AS rate_0,
       {_percent('affected / ce', 1)} AS rate_1, {_percent('affected / ce', 2)} AS rate_2
FROM panel"""

# --- Indicators -------------------------------------------------------------------------

_RATES = f"""
rates AS (SELECT *, CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN CAST(ce * 100 - affected * 50 AS DOUBLE) / ce END AS grad,
                 CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN CAST(pending * 30 AS DOUBLE) / ce END AS drp,
                 CAST(affected * 10 AS DOUBLE) / ce AS susp,
                 CAST(pending * 1000 AS DOUBLE) / ce AS exp
          FROM panel)"""


def _trend(figure: str, measure: str, digits: int, limits: tuple[float, float] | None) -> str:
    return _chart(
        figure, "academic_year", f"{measure} / 100", f"rates WHERE {_TREND}",
        series=_GEO, label=_percent(f"{measure} / 100", digits), limits=limits,
    )


_GRADUATION = _trend("graduation_trend", "grad", 0, (0.75, 0.9))
_DROPOUT = _trend("dropout_trend", "drp", 1, (0, 0.15))
ORACLES["graduation_trend"] = _with(PANEL, _RATES) + _GRADUATION
ORACLES["dropout_trend"] = _with(PANEL, _RATES) + _DROPOUT
ORACLES["graduation_trend_labels"] = _with(PANEL, _RATES, f"trend AS ({_GRADUATION})") + """
SELECT * FROM trend WHERE x = (SELECT max(x) FROM trend)"""


def _by_group(
    figure: str, value: str, label: str, names: str, sentinel: str, extra: str = "true"
) -> tuple[list[str], str]:
    frame = f"""
frame AS (SELECT r.*, student_group, {value} AS shown FROM rates r LEFT JOIN names USING (cat)
          WHERE county_code = '{FOCUS.county_code}' AND {sentinel} AND {extra} AND cat <> 'TA'
            AND academic_year = (SELECT max(academic_year) FROM panel))"""
    select = _chart(
        figure, "student_group", "shown",
        "frame JOIN ranked ON student_group IS NOT DISTINCT FROM lname",
        label=label, facet=_FAMILY, level="lvl",
    )
    return [PANEL, _RATES, names, frame, _ranked("frame", "student_group", "median(shown)")], select


def _put_by_group(key: str, *args: str) -> None:
    ctes, select = _by_group(key, *args)
    ORACLES[key] = _with(*ctes) + select


_EXP_LABEL = f"regexp_replace(CAST({_half_away('exp', 2)} AS VARCHAR), '\\.0$', '')"
_put_by_group("graduation_by_group", "grad / 100", _percent("shown", 1), _BOOK_NAMES, _WHOLE, "grad IS NOT NULL")
_put_by_group("dropout_by_group", "drp / 100", _percent("shown", 1), _BOOK_NAMES, _WHOLE, "grad IS NOT NULL")
_put_by_group("suspension_by_group", "susp / 100", _percent("shown", 1), _NAMES, _WHOLE)
_put_by_group("expulsion_by_group", "exp", _EXP_LABEL, _NAMES, _WHOLE)

_SUSPENSION = _chart(
    "suspension_trend", "academic_year", "susp", f"rates WHERE {_TREND}",
    series=_GEO, label=_percent("susp / 100", 1),
)
_EXPULSION = _chart(
    "expulsion_trend", "academic_year", "exp", f"rates WHERE {_TREND}", series=_GEO, label=_EXP_LABEL
)
ORACLES["suspension_trend"] = _with(PANEL, _RATES) + _SUSPENSION
ORACLES["expulsion_trend"] = _with(PANEL, _RATES) + _EXPULSION

_CGR = f"CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN CAST((ce * 4000 + affected * 6000) // ce AS DOUBLE) / 100 END / 100"
_COLLEGE = _chart(
    "college_going_trend", "academic_year", _CGR, f"panel WHERE {_TREND}",
    series=_GEO, label=_percent(_CGR, 1), limits=(0.5, 0.7),
)
ORACLES["college_going_trend"] = _with(PANEL) + _COLLEGE

_COUNTY = f"county_code = '{FOCUS.county_code}'"
_NAME = _text(FOCUS.county_name)
_COUNTS = {
    "total_enrollment": ("TA", (60000, 80000)),
    "homeless": ("SH", (0, 10000)),
    "unduplicated_frpm_eligible_count": ("RB", (50000, 60000)),
    "english_learner_el": ("RA", (25000, 35000)),
}
# A district without rows of a category has no count, and then neither has the county.
_COUNT_CTES = [
    f"""upc AS (SELECT academic_year, district_code, {', '.join(
        f"max(ce) FILTER (cat = '{cat}') AS {m}" for m, (cat, _) in _COUNTS.items())}
        FROM panel WHERE district_code IS NOT NULL AND charter = 'All' AND {_COUNTY} GROUP BY 1, 2)""",
    *[
        f"""s_{m} AS (SELECT academic_year, CASE WHEN count({m}) = count(*) THEN CAST(sum({m}) AS BIGINT) END AS v
            FROM upc GROUP BY 1)"""
        for m in _COUNTS
    ],
]
_COUNTED = " UNION ALL ".join(
    _chart(f"pupil_count_{m}", "academic_year", "v", f"s_{m}", series=_NAME, label=_comma("v"), limits=lim)
    for m, (_, lim) in _COUNTS.items()
)
ORACLES["pupil_counts"] = _with(PANEL, *_COUNT_CTES) + _COUNTED

_SPED = _chart("special_education", "page_id", "v", "cells", series=_NAME, label=_comma("v"), limits=(5000, 10000))
ORACLES["special_education_cells"] = _with("cells AS (SELECT page_id, length(html) AS v FROM pages)") + _SPED


def _enrollment(category: str, limits: tuple[float, float]) -> str:
    return _chart(
        f"cumulative_enrollment_{category}", "academic_year", "ce",
        f"panel WHERE {_COUNTY} AND {_WHOLE} AND cat = '{category}'",
        series=_NAME, label=_comma("ce"), limits=limits,
    )


def _share(category: str, limits: tuple[float, float]) -> str:
    source = f"""(SELECT academic_year, CAST(max(ce) FILTER (cat = '{category}') AS DOUBLE)
                         / max(ce) FILTER (cat = 'TA') AS v
                  FROM panel WHERE {_COUNTY} AND {_WHOLE} AND cat IN ('{category}', 'TA') GROUP BY 1)"""
    return _chart(
        f"enrollment_share_{category}", "academic_year", "v", source,
        series=_NAME, label=_percent("v", 1), limits=limits,
    )


ORACLES["cum_enrollment"] = _with(PANEL) + _enrollment("SH", (5000, 14000))
ORACLES["share_of_total"] = _with(PANEL) + _share("RB", (0.15, 0.2))


def _fitness_branch(category: str, grade: int) -> str:
    return f"""SELECT academic_year, aggregate_level, '{grade}' AS grade,
    max(CAST((ce - affected) * 100 AS DOUBLE) / ce) FILTER (cat = '{category}') / 100 AS v
    FROM panel WHERE (aggregate_level = 'T' OR ({_COUNTY} AND aggregate_level = 'C'))
      AND charter = 'All' AND cat IN ('RB', 'RA', 'GF') GROUP BY 1, 2"""


_FIT = "fit AS (" + " UNION ALL ".join(
    _fitness_branch(c, g) for c, g in (("RB", 5), ("RA", 7), ("GF", 9))
) + ")"
_FITNESS = _chart(
    "fitness_by_grade", "academic_year", "v", "fit",
    series=f"(CASE WHEN aggregate_level = 'T' THEN '{FOCUS.state_name}' ELSE {_NAME} END) || ' ' || grade",
    label=_percent("v", 0), limits=(0.5, 0.8),
)
ORACLES["fitness_by_grade"] = _with(PANEL, _FIT) + _FITNESS

_BOOK = [("1", "All Students"), ("3", "Female"), ("4", "Male"), ("52", "TBD"), ("74", "Black"), ("204", "Asian, disadvantaged")]
_TESTED = f"""
tested AS (
  SELECT *, CASE WHEN ce >= {S.SUPPRESS_BELOW}
                 THEN CAST(((CASE test WHEN 1 THEN affected ELSE pending END) * 10000) // ce AS DOUBLE) / 100 END AS met,
         {_case('cat', dict(S.SUBGROUP_IDS))} AS subgroup
  FROM panel, (VALUES (1), (2)) AS t(test)
  WHERE aggregate_level IN ('T', 'C') AND charter = 'All'
    AND (aggregate_level = 'T' OR {_COUNTY}))"""
_TESTED_GEO = f"(CASE WHEN aggregate_level = 'T' THEN '{FOCUS.state_name}' ELSE {_NAME} END)"
_ASSESSED = " UNION ALL ".join(
    _chart(
        f"{name}_trend", "yr", "met / 100", f"tested WHERE test = {test} AND subgroup = 1",
        series=_TESTED_GEO, label=_percent("met / 100", 1), limits=(0, 0.6),
    )
    for test, name in ((1, "ela"), (2, "math"))
)
ORACLES["assessment_trend"] = _with(PANEL, _TESTED) + _ASSESSED

_FACETS = " ".join(
    f"WHEN subgroup IN ({', '.join(map(str, ids))}) THEN {_text(n)}" for n, ids in SUBGROUP_FAMILIES.items()
)
ORACLES["assessment_by_group"] = _with(
    PANEL,
    _TESTED,
    f"book(code, student_group) AS (VALUES {_values(_BOOK)})",
    f"""frame AS (SELECT * FROM (
          SELECT t.*, student_group, CASE {_FACETS} END AS family
          FROM tested t LEFT JOIN book ON code = CAST(subgroup AS VARCHAR))
        WHERE test = 1 AND {_COUNTY} AND yr = (SELECT max(yr) FROM tested)
          AND NOT regexp_matches(student_group, 'TBD') AND NOT regexp_matches(family, 'Ethnicity for'))""",
    _ranked("frame", "student_group", "median(met)"),
) + _chart(
    "ela_by_group", "student_group", "met / 100",
    "frame JOIN ranked ON student_group IS NOT DISTINCT FROM lname",
    label=_percent("met / 100", 1), facet="family", level="lvl",
)

# Every group of the wide file has a column for every year, filled or not.
_WIDE = f"""
wide AS (
  SELECT county_code, cat, test, y.yr, CASE y.yr WHEN 2001 THEN '2018-19' WHEN 2000 THEN '2017-18'
         WHEN 1999 THEN '2016-17' ELSE CAST(y.yr - 1982 AS VARCHAR) END AS year, met
  FROM (SELECT DISTINCT county_code, cat FROM panel
        WHERE aggregate_level IN ('T', 'C') AND charter = 'All' AND county_code IN ('00', '{FOCUS.county_code}')) g
  CROSS JOIN (VALUES ('ELA'), ('Math')) AS t(test)
  CROSS JOIN (VALUES (1995), (1996), (1997), (1998), (1999), (2000), (2001)) AS y(yr)
  LEFT JOIN (SELECT county_code, cat, yr, t.test,
                    CAST((CASE t.test WHEN 'ELA' THEN affected ELSE pending END) * 100 AS DOUBLE) / ce AS met
             FROM panel, (VALUES ('ELA'), ('Math')) AS t(test)
             WHERE aggregate_level IN ('T', 'C') AND charter = 'All') m
  USING (county_code, cat, yr, test))"""
_WIDE_GEO = f"(CASE WHEN county_code = '00' THEN '{FOCUS.state_name}' ELSE {_NAME} END)"
ORACLES["assessment_wide_trend"] = _with(PANEL, _WIDE) + _chart(
    "math_wide_trend", "year", "met / 100", "wide WHERE test = 'Math' AND cat = 'TA'",
    series=_WIDE_GEO, label=_percent("met / 100", 0), limits=(0, 0.6),
)
ORACLES["assessment_wide_by_group"] = _with(
    PANEL,
    _WIDE,
    f"""frame AS (SELECT *, 'Group ' || cat AS gname FROM wide
        WHERE test = 'ELA' AND {_COUNTY} AND cat <> 'RA' AND year = (SELECT max(year) FROM wide))""",
    _ranked("frame", "gname", "median(met)"),
) + _chart(
    "ela_wide_by_group", "gname", "met / 100", "frame JOIN ranked ON gname = lname",
    label=_percent("met / 100", 1), facet="substring(cat, 1, 1)", level="lvl",
)


def _learners(figure: str, year: str, where: str, reclassified: str, learners: str) -> str:
    source = f"""(
  SELECT {year} AS year, 'Reclassified Students' AS name, CAST(sum({reclassified}) AS DOUBLE) AS v
  FROM panel WHERE {where} GROUP BY 1
  UNION ALL
  SELECT {year}, 'EL Enrollment', CAST(sum({learners}) AS DOUBLE) FROM panel WHERE {where} GROUP BY 1)"""
    return _chart(figure, "year", "v", source, series="name", label=_comma("v"), limits=(0, 35000))


_RECLASS_YEAR = "('20' || CAST(yr - 1981 AS VARCHAR) || '-20' || CAST(yr - 1980 AS VARCHAR))"
_RECLASS = _learners(
    "reclassification", _RECLASS_YEAR,
    f"district_code IS NOT NULL AND charter = 'All' AND cat = 'TA' AND {_COUNTY}", "affected", "ce",
)
ORACLES["reclassification"] = _with(PANEL) + _RECLASS
ORACLES["reclassification_files"] = _with(PANEL) + _RECLASS
_ELAS = _learners(
    "language_status", "academic_year",
    f"district_code IS NULL AND charter <> 'All' AND cat = 'TA' AND {_COUNTY}", "affected", "pending",
)
ORACLES["language_status"] = _with(PANEL) + _ELAS


def _burden(where: str) -> str:
    shown = f"CASE WHEN ce < {S.SUPPRESS_BELOW} THEN '*' ELSE CAST(affected AS VARCHAR) END"
    return _with(PANEL) + f"""
SELECT academic_year, district_code, district_name,
       CASE WHEN aggregate_level = 'D1' THEN '0' END AS school_code,
       {shown} AS total_suspensions, CAST(ce AS VARCHAR) AS cumulative_enrollment,
       {_number(shown)} * 100 / ce AS burden
FROM panel WHERE charter = 'N' AND {where}"""


ORACLES["enrollment_floor_topn"] = _burden("cat = 'TA' AND academic_year = '2000-01' AND ce >= 5")
ORACLES["suspension_burden_district"] = _burden("cat = 'TA' AND district_code = '00005'")
ORACLES["suspension_burden_group"] = _burden("cat = 'RB' AND district_code = '00005'")

# --- Workbook sheets --------------------------------------------------------------------

_SHEET_GEO = _title(
    "replace(replace(lower(county_name), 'middle east', 'middle east county'), 'county county', 'county')"
)
_WHOLES = "aggregate_level IN ('T', 'C') AND charter = 'All'"
_TIDY_GROUPS = {
    "RB": "English Only (EO)",
    "RA": "Dis-Abilities",
    "GF": "Female",
    "GM": "Male",
    "SH": "Learners (ELs)",
}


def _mean(column: str) -> str:
    return f"avg(CAST({column} AS DOUBLE))"


ORACLES["demographics_by_group"] = _with(
    PANEL,
    f"""frame AS (SELECT {_SHEET_GEO} AS geo, {_case('cat', dict(_TIDY_GROUPS))} AS grp,
          CAST(part AS DOUBLE) / whole AS v
        FROM (SELECT county_name, cat, sum(ce) AS part FROM panel WHERE {_WHOLES} AND cat <> 'TA' GROUP BY 1, 2)
        JOIN (SELECT county_name, sum(ce) AS whole FROM panel WHERE {_WHOLES} AND cat = 'TA' GROUP BY 1)
        USING (county_name))""",
    _ranked("frame", "grp", _mean("v")),
) + _chart(
    "demographics", "grp", "v", "frame JOIN ranked ON grp = lname",
    series="geo", label=_percent("v", 0), level="lvl",
)

ORACLES["personnel_ratio"] = _with(
    PANEL,
    f"""frame AS (SELECT county_name AS geo, {_case('cat', dict(S.STAFF))} AS grp,
          CAST(sum(pending) AS BIGINT) AS v
        FROM panel WHERE {_WHOLES} AND cat NOT IN ('TA', 'SH') GROUP BY 1, 2)""",
    _ranked("frame", "grp", _mean("v")),
) + _chart(
    "personnel", "grp", "v", "frame JOIN ranked ON grp = lname",
    series="geo", label="CAST(v AS VARCHAR)", level="lvl",
)

ORACLES["foster_trend"] = _with(PANEL, _FOSTER) + _chart(
    "foster_trend", "academic_year", "rate", "foster",
    series="county_name", label=_percent("rate", 2), limits=(0, 0.0035),
)


def _sheet_trend(figure: str, measure: str, scale: int, digits: int, limits: tuple[float, float] | None) -> None:
    rate = f"(CAST({measure} AS DOUBLE) / (ce * {scale}))"
    ORACLES[figure] = _with(PANEL) + _chart(
        figure, "academic_year", rate, f"panel WHERE {_WHOLES} AND cat = 'TA'",
        series="county_name", label=_percent(rate, digits), limits=limits,
    )


_sheet_trend("homeless_trend", "affected", 10, 1, (0, 0.1))
_sheet_trend("graduation_sheet_trend", "affected", 1, 0, None)
_sheet_trend("suspension_sheet_trend", "pending", 1, 1, (0.03, 0.07))
_sheet_trend("expulsion_sheet_trend", "pending", 20, 2, (0, 0.002))

ORACLES["graduation_sheet_by_group"] = _with(
    PANEL,
    f"""frame AS (SELECT {_SHEET_GEO} AS geo, {_case('cat', dict(_TIDY_GROUPS))} AS grp, CAST(part AS DOUBLE) / whole AS v
        FROM (SELECT county_name, cat, sum(affected) AS part, sum(ce) AS whole
              FROM panel WHERE {_WHOLES} AND cat <> 'TA' GROUP BY 1, 2))""",
    _ranked("frame", "grp", _mean("v")),
) + _chart(
    "graduation_sheet_by_group", "grp", "v", "frame JOIN ranked ON grp = lname",
    series="geo", label=_percent("v", 0), level="lvl",
)


def _sheet(measure: str) -> str:
    years = ", ".join(f"({_text(y)})" for y in S.YEARS)
    return f"""
sheet AS (
  SELECT county_name, {_SHEET_GEO} AS geo, cat, academic_year, CAST({measure} AS DOUBLE) / ce AS v
  FROM (SELECT DISTINCT county_name, cat FROM panel WHERE {_WHOLES})
  CROSS JOIN (VALUES {years}) AS y(academic_year)
  LEFT JOIN (SELECT * FROM panel WHERE {_WHOLES}) USING (county_name, cat, academic_year))"""


ORACLES["assessment_sheet_by_group"] = _with(
    PANEL,
    _sheet("affected"),
    f"""frame AS (SELECT *, {_case('cat', dict(_TIDY_GROUPS))} AS grp FROM sheet
        WHERE cat IN ('RB', 'RA', 'SH') AND academic_year = '2001-02')""",
    _ranked("frame", "grp", _mean("v")),
) + _chart(
    "ela_sheet_by_group", "grp", "v", "frame JOIN ranked ON grp = lname",
    series="geo", label=_percent("v", 0), level="lvl",
)

ORACLES["assessment_sheet_by_grade"] = _with(PANEL, _sheet("pending")) + _chart(
    "math_sheet_by_grade", "academic_year", "v",
    f"sheet WHERE cat IN ('GF', 'GM', 'TA') AND county_name = {_NAME}",
    series=_case("cat", dict(S.GRADE_TEXTS)),
    level="(CASE cat WHEN 'GF' THEN 1 WHEN 'TA' THEN 2 WHEN 'GM' THEN 3 END)",
    limits=(0.2, 0.35),
)

ORACLES["assessment_table"] = _with(PANEL, _sheet("pending")) + f"""
SELECT {_case('cat', dict(S.GROUP_TEXTS))} AS "Subgroup", {', '.join(
    f'''max({_percent("v", 0)}) FILTER (academic_year = {_text(y)}) AS "{y}"''' for y in S.YEARS)}
FROM sheet WHERE cat IN ('RB', 'RA', 'SH') GROUP BY county_name, cat"""

_FRAME_ROWS = f"(aggregate_level = 'T' OR {_COUNTY}) AND district_code IS NULL AND cat = 'TA'"
ORACLES["suspension_frame"] = _with(PANEL) + f"""
SELECT academic_year, {_GEO} AS geo,
       CASE WHEN yr >= 1999 AND charter = 'N' THEN 'No ' ELSE charter END AS charter_yn,
       CAST(ce AS DOUBLE) AS cumulative_enrollment,
       CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN CAST(affected AS DOUBLE) END AS total_suspensions,
       CASE WHEN ce >= {S.SUPPRESS_BELOW} THEN CAST(CASE WHEN yr < 1999 THEN affected ELSE pending END AS DOUBLE)
       END AS suspension_count_of_students_suspended_defiance_only2
FROM panel WHERE {_FRAME_ROWS}"""

ORACLES["expulsion_frame"] = _with(PANEL) + f"""
SELECT academic_year, {_GEO} AS geo,
       CASE WHEN charter <> 'All' THEN charter WHEN yr < 1997 THEN NULL WHEN yr = 1997 THEN ''
            ELSE 'All' END AS charter_yn,
       CAST(pending AS DOUBLE) / ce AS rate
FROM panel WHERE {_FRAME_ROWS}"""

# --- The report -------------------------------------------------------------------------

_SUSP_CTES, _SUSP_GROUP = _by_group("suspension_by_group", "susp / 100", _percent("shown", 1), _NAMES, _WHOLE)
_LIMITS = {
    "TA": (70000, 85000), "SH": (5000, 14000), "SS": (55000, 65000), "SE": (20000, 40000), "SD": (6000, 12000),
}


def _numbered_group(number: int, names: str, *args: str) -> tuple[list[str], str]:
    """A by-group chart beside others: its tables bear a number."""
    ctes, select = _by_group(*args[:3], names, *args[3:])
    own = {"names": f"names{number}", "frame": f"frame{number}", "ranked": f"ranked{number}"}
    swap = lambda sql: re.sub(r"\b(names|frame|ranked)\b", lambda m: own[m[0]], sql)
    return [swap(c) for c in ctes[2:]], swap(select)


_EXP_CTES, _EXP_GROUP = _numbered_group(2, _NAMES, "expulsion_by_group", "exp", _EXP_LABEL, _WHOLE)
_GRAD_CTES, _GRAD_GROUP = _numbered_group(
    3, _BOOK_NAMES, "graduation_by_group", "grad / 100", _percent("shown", 1), _WHOLE, "grad IS NOT NULL"
)
_DROP_CTES, _DROP_GROUP = _numbered_group(
    4, _BOOK_NAMES, "dropout_by_group", "drp / 100", _percent("shown", 1), _WHOLE, "grad IS NOT NULL"
)


def _assessed_group(number: int, test: int, figure: str) -> tuple[list[str], str]:
    frame = f"""frame{number} AS (SELECT * FROM (
          SELECT t.*, student_group, CASE {_FACETS} END AS family
          FROM tested t LEFT JOIN book ON code = CAST(subgroup AS VARCHAR))
        WHERE test = {test} AND {_COUNTY} AND yr = (SELECT max(yr) FROM tested)
          AND NOT regexp_matches(student_group, 'TBD') AND NOT regexp_matches(family, 'Ethnicity for'))"""
    ranked = _ranked(f"frame{number}", "student_group", "median(met)").replace("ranked AS", f"ranked{number} AS")
    return [frame, ranked], _chart(
        figure, "student_group", "met / 100",
        f"frame{number} JOIN ranked{number} ON student_group IS NOT DISTINCT FROM lname",
        label=_percent("met / 100", 1), facet="family", level="lvl",
    )


_ELA_CTES, _ELA_GROUP = _assessed_group(5, 1, "ela_by_group")
_MATH_CTES, _MATH_GROUP = _assessed_group(6, 2, "math_by_group")
ORACLES["report_chart_rows"] = _with(
    *_SUSP_CTES,
    *_EXP_CTES,
    *_GRAD_CTES,
    *_DROP_CTES,
    _FIT,
    _TESTED,
    f"book(code, student_group) AS (VALUES {_values(_BOOK)})",
    *_ELA_CTES,
    *_MATH_CTES,
    *_COUNT_CTES,
    "cells AS (SELECT page_id, length(html) AS v FROM pages)",
) + " UNION ALL ".join(
    [
        _GRADUATION,
        _GRAD_GROUP,
        _DROPOUT,
        _DROP_GROUP,
        _COLLEGE,
        *[_enrollment(c, lim) for c, lim in _LIMITS.items()],
        _share("SS", (0.65, 0.8)),
        _COUNTED,
        _SPED,
        _SUSPENSION,
        _SUSP_GROUP,
        _EXPULSION,
        _EXP_GROUP,
        _FITNESS,
        _ASSESSED,
        _ELA_GROUP,
        _MATH_GROUP,
        _RECLASS,
        _ELAS,
    ]
)
