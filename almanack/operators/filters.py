"""Row filters every indicator shares."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.logic import _col, if_else
from almanack.functions.numbers import strict_max


@dataclass(frozen=True)
class Geography:
    """The one county a report is about, set against the state."""

    county_code: str
    county_name: str
    state_name: str = "California"
    state_code: str = "00"
    state_level: str = "T"


def in_geography(
    geo: Geography, level: str = "aggregate_level", county: str = "county_code"
) -> Column:
    """State rows, or any row of the focus county."""
    return (F.col(level) == geo.state_level) | (F.col(county) == geo.county_code)


def geo_column(
    geo: Geography, level: str = "aggregate_level", county_name: str = "county_name"
) -> Column:
    """Display name of a row's geography; NULL where the level is unknown."""
    return if_else(F.col(level) == geo.state_level, geo.state_name, F.col(county_name))


def _latest(df: DataFrame, column: str, strict: bool) -> Column:
    newest = strict_max(column) if strict else F.max(column)
    return F.col(column) == df.select(newest).scalar()


def at_latest(
    df: DataFrame, column: str, *conditions: Column, strict: bool = False
) -> DataFrame:
    """Rows meeting all conditions in the newest year **of the whole frame**.

    The year is taken before the sibling conditions apply, so a county without data for
    that year yields nothing. The maximum is a scalar subquery: one column of the frame,
    reduced to a single value, with no shuffle of the rows. On a table partitioned by the
    column it prunes partitions. A missing year is ignored as a database does; ``strict``
    makes the newest year unknown if any year is missing, and then no row is kept.
    """
    return df.where(reduce(and_, conditions, _latest(df, column, strict)))


def chain_latest(
    df: DataFrame, column: str, *conditions: Column, strict: bool = False
) -> DataFrame:
    """Rows meeting all conditions in the newest year **among those rows**."""
    kept = df.where(reduce(and_, conditions)) if conditions else df
    return kept.where(_latest(kept, column, strict))


def matches_any(c: Column | str, parts: Iterable[str]) -> Column:
    """Regex search for any of several parts."""
    return _col(c).rlike("|".join(parts))


def first_by(df: DataFrame, ordinal: str, *columns: str) -> DataFrame:
    """The row with the smallest ordinal, the first element of an ordered series."""
    return df.orderBy(F.col(ordinal).asc_nulls_last()).limit(1).select(*columns)
