"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.functions.numbers import to_number

#: Different names that a pivot may find.
MOST_NAMES = 1_000


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column to another, both included, in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def columns_from(df: DataFrame, prefix: str) -> list[str]:
    """Names starting with a prefix, ignoring case."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def numbers_in(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles; suppressed text cells become NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cast = {}
    for c in columns:
        column = F.col(f"`{c}`")
        is_text = isinstance(types[c], T.StringType)
        cast[c] = to_number(column) if is_text else column.cast("double")
    return df.withColumns(cast)


def lengthen(
    df: DataFrame,
    columns: Sequence[str] | None,
    ids: Sequence[str] | None = None,
    name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Columns to rows, keeping NULL values.

    Without ``ids`` every other column identifies a row; without ``columns`` every column
    that is not an id is lengthened. No shuffle.
    """
    if columns is None and ids is None:
        raise ValueError("give columns, ids or both")
    columns = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    ids = [c for c in df.columns if c not in columns] if ids is None else list(ids)
    quoted = [F.col(f"`{c}`") for c in columns]
    return df.unpivot([F.col(f"`{c}`") for c in ids], quoted, name, value)


def _only(value: Column, where: Column) -> Column:
    """The single value of a cell; a second row for the same cell fails the job."""
    return F.when(F.count_if(where) <= 1, F.max(F.when(where, value))).otherwise(
        F.raise_error(F.lit("several rows for one cell"))
    )


def widen(
    df: DataFrame,
    ids: Sequence[str],
    names_from: str,
    names: Sequence[Any],
    values_from: Sequence[str],
) -> DataFrame:
    """Rows to columns named measure_name, for numeric measures.

    The names are given, so no extra job discovers them, and every cell is a conditional
    aggregate that Spark combines map-side in a single shuffle on the ids. A row with a name that
    is not among them fails the job, so that none is lost unseen; filter such rows first. None among
    the names stands for missing ones, whose columns end in NA.
    """
    known = F.coalesce(F.col(names_from).isin([n for n in names if n is not None]), F.lit(None in names))
    unlisted = F.count_if(~known)
    cells = [
        F.when(unlisted == 0, _only(F.col(v), F.col(names_from).eqNullSafe(F.lit(n))))
        .otherwise(F.raise_error(F.lit("a name that is not listed")))
        .alias(f"{v}_{'NA' if n is None else n}")
        for v in values_from
        for n in names
    ]
    return df.groupBy(*ids).agg(*cells)


def found_names(df: DataFrame, column: str, most: int = MOST_NAMES) -> list[Any]:
    """The values of a column in rising order, a missing one last; more than ``most`` are an error.

    Each becomes columns of a table, so their number has to be small. Only that many reach the driver.
    """
    names = df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(most + 1).collect()
    if len(names) > most:
        raise ValueError(f"{column} has more than {most} different values")
    return [r[0] for r in names]


def widen_found(
    df: DataFrame, ids: Sequence[str], names_from: str, values_from: Sequence[str], most: int = MOST_NAMES
) -> DataFrame:
    """As ``widen``, under all names that occur: a first pass finds them, the second makes the columns."""
    return widen(df, ids, names_from, found_names(df, names_from, most), values_from)


def share_of_total(
    df: DataFrame, ids: Sequence[str], names_from: str, part: str, total: str, value: str
) -> DataFrame:
    """ids, part and total side by side, and their ratio as ``share``."""
    both = df.where(F.col(names_from).isin(part, total))
    wide = widen(both, ids, names_from, [part, total], [value])
    return wide.select(
        *ids,
        F.col(f"{value}_{part}").alias("part"),
        F.col(f"{value}_{total}").alias("total"),
        F.try_divide(
            F.col(f"{value}_{part}").cast("double"), F.col(f"{value}_{total}").cast("double")
        ).alias("share"),
    )
