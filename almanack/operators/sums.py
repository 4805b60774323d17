"""Grouped sums. Spark combines them map-side, so a hot key never travels row by row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.logic import _col
from almanack.functions.numbers import strict_sum
from almanack.operators.reshape import lengthen


def _total(strict: bool) -> Callable[[Column | str], Column]:
    return strict_sum if strict else lambda c: F.sum(_col(c))


def group_sums(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column | str], strict: bool = True
) -> DataFrame:
    """One row per key with the named sums.

    By default a NULL input makes its sum NULL, as an incomplete total is not a total;
    ``strict=False`` ignores NULLs.
    """
    total = _total(strict)
    return df.groupBy(*keys).agg(*[total(c).alias(n) for n, c in measures.items()])


def with_group_sums(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column | str],
    strict: bool = True,
    salts: int = 16,
) -> DataFrame:
    """Every row with its group's sums. NULL keys form a group of their own.

    A window over the keys, or a join shuffled on them, would bring a hot group into one task. The
    sums are made first, with map-side combining, and repeated once per salt; each row meets the
    copy of its salt, a hash of all its columns. So a group of any size is spread over ``salts``
    tasks by one plan; only rows that are equal in every column stay together.
    """
    total = _total(strict)
    kept = {k: f"_{k}" for k in keys}
    match = [F.col(k).eqNullSafe(F.col(o)) for k, o in kept.items()]
    sums = (
        df.groupBy(*keys)
        .agg(*[total(c).alias(n) for n, c in measures.items()])
        .select(
            *[F.col(k).alias(o) for k, o in kept.items()],
            F.struct(*measures).alias("_sums"),
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy"),
        )
    )
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    rows = df.withColumn("_salt", salt).join(sums, [*match, F.col("_salt") == F.col("_copy")])
    return rows.select(*df.columns, *[F.col(f"_sums.{n}").alias(n) for n in measures])


def sums_by_name(
    df: DataFrame, key: str, measures: Mapping[str, Column | str], strict: bool = True
) -> DataFrame:
    """Sums per key in long form: key, name, value, one row per measure."""
    sums = group_sums(df, [key], measures, strict)
    return lengthen(sums, list(measures))


def measure_by_year(
    df: DataFrame, measure: Column | str, year: str = "academic_year", strict: bool = True
) -> DataFrame:
    """year, value: one caller-chosen measure summed per year."""
    return group_sums(df, [year], {"value": measure}, strict).withColumnRenamed(year, "year")


def pooled_rate(
    df: DataFrame, keys: Sequence[str], part: str, whole: str, strict: bool = True
) -> DataFrame:
    """Both sums and their ratio. A pooled rate is a ratio of sums, never a mean of rates."""
    sums = group_sums(df, keys, {whole: whole, part: part}, strict)
    return sums.withColumn(
        "rate", F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values a column takes."""
    return df.select(column).distinct()
