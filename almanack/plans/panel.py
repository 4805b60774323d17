"""A statistical panel derived from the order tables.

It has the shape of the published tables: rows already rolled up, totals beside their
parts, with a sentinel in each rolled dimension. Regions stand for counties and nations for
districts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.folders import stored
from almanack.functions import match_value
from almanack.operators.filters import Geography

FOCUS = Geography(county_code="05", county_name="MIDDLE EAST", state_name="Statewide")

CATEGORIES = {
    "BUILDING": "RB",
    "AUTOMOBILE": "RA",
    "FURNITURE": "GF",
    "MACHINERY": "GM",
    "HOUSEHOLD": "SH",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MEASURES = ("enrolled", "finished", "pending")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per year, district, category and charter flag.

    Orders meet their customers once and are counted map-side straight behind the join, per district code
    before names are added, so only a handful of rows goes on. A customer with a large part of all
    orders is a skewed join, which adaptive execution splits.
    """
    status = F.col("o_orderstatus")
    charter = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Y").otherwise("N")
    per_district = (
        read(spark, sf_dir, "orders")
        .join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.year("o_orderdate").alias("year"), "c_nationkey", "c_mktsegment", charter.alias("charter"))
        .agg(
            F.count(F.lit(1)).alias("enrolled"),
            F.count_if(status == "F").alias("finished"),
            F.count_if(status == "P").alias("pending"),
        )
    )
    places = read(spark, sf_dir, "nation").join(
        read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return per_district.join(places, F.col("c_nationkey") == F.col("n_nationkey"))


#: Folder and state of the stored panel by session and data folder.
_STORED: dict[tuple[str, str], tuple[tuple[int, ...], DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple[int, ...]:
    """Files, bytes and a sum over names, lengths and times of the panel's tables; no content is read."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("orders", "customer", "nation", "region")]
    files = spark.read.format("binaryFile").load(paths)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(int(x or 0) for x in files.agg(F.count("*"), F.sum("length"), F.sum(mark)).first())


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of a data folder as a stored table, like the published tables that it stands for.

    It is derived when first asked for and again whenever a file of its tables has changed, which every call
    looks up. Its size depends on dimensions only.
    """
    key, state = (spark.sparkContext.applicationId, sf_dir), _state(spark, sf_dir)
    if key not in _STORED or _STORED[key][0] != state:
        _STORED[key] = state, stored(derive(spark, sf_dir).coalesce(1), "panel")
    return _STORED[key][1]


def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly rows at state, county and district level, for each category and charter flag."""
    county, district = ["r_regionkey", "r_name"], ["n_nationkey", "n_name"]
    places = [[], county, county + district]
    sets = [
        ["year", *place, *category, *charter]
        for place in places
        for category in ([], ["c_mktsegment"])
        for charter in ([], ["charter"])
    ]
    rolled = facts(spark, sf_dir).groupingSets(
        sets, "year", *county, *district, "c_mktsegment", "charter"
    ).agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        F.grouping("r_regionkey").alias("all_counties"),
        F.grouping("n_nationkey").alias("all_districts"),
        F.grouping("c_mktsegment").alias("all_categories"),
        F.grouping("charter").alias("all_charters"),
    )
    code = lambda key, width: F.lpad((F.col(key) + 1).cast("string"), width, "0")
    is_district = F.col("all_districts") == 0
    return rolled.select(
        F.concat(
            F.col("year").cast("string"),
            F.lit("-"),
            F.lpad(((F.col("year") + 1) % 100).cast("string"), 2, "0"),
        ).alias("academic_year"),
        F.when(F.col("all_counties") == 1, "T")
        .when(~is_district, "C")
        .when(F.col("n_nationkey") % 2 == 0, "D1")
        .otherwise("D2")
        .alias("aggregate_level"),
        F.when(F.col("all_counties") == 1, FOCUS.state_code)
        .otherwise(code("r_regionkey", 2))
        .alias("county_code"),
        F.when(F.col("all_counties") == 1, "State").otherwise(F.col("r_name")).alias("county_name"),
        F.when(is_district, code("n_nationkey", 5)).alias("district_code"),
        F.when(is_district, F.col("n_name")).alias("district_name"),
        F.when(F.col("all_charters") == 1, "All").otherwise(F.col("charter")).alias("charter"),
        F.when(F.col("all_categories") == 1, "TA")
        .otherwise(match_value("c_mktsegment", CATEGORIES))
        .alias("reporting_category"),
        F.col("enrolled").alias("cumulative_enrollment"),
        F.col("finished").alias("affected"),
        F.col("pending"),
    )
