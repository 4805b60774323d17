"""Category orders. An ordered factor is a label column plus an integer level column."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Relative error of the approximate ranks that enclose a median, and the distance they keep from it.
_ACCURACY = 100_000
_MARGIN = 4 / _ACCURACY
# Ranges that labels are numbered in.
_RANGES = 128


def exact_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median: the exact median per key; NULL and NaN count as missing, infinities as values.

    ``F.median`` holds all distinct values of a group in one task. Here a summary of bounded size, merged map-side,
    gives two values that enclose the median closely: their ranks are known to a part in 100,000, and they
    stand off further than that. Smaller values are then only counted, larger ones left out, and the values between,
    a ten-thousandth of the group at most, are counted by value and walked through in order. So a hot
    group travels as counts, however its values are spread. A median outside its bounds fails the job.

    Every key is returned; one without values has a NULL median.
    """
    keys = list(keys)
    v, total = F.col("_v"), F.col("_total")
    number = F.col(value).cast("double")
    rows = df.select(*keys, F.when(~F.isnan(number), number).alias("_v"))
    ranks = F.array(F.lit(0.5 - _MARGIN), F.lit(0.5 + _MARGIN))
    other = {c: f"_k_{c}" for c in keys}
    bounds = (
        rows.groupBy(*keys)
        .agg(F.count("_v").alias("_total"), F.percentile_approx("_v", ranks, F.lit(_ACCURACY)).alias("_bounds"))
        .select(*[F.col(c).alias(o) for c, o in other.items()], "_total", F.col("_bounds")[0].alias("_low"), F.col("_bounds")[1].alias("_high"))
    )
    rows = rows.join(bounds, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
    place = F.when(total == 0, -1).when(v < F.col("_low"), 0).when(v <= F.col("_high"), 1)
    counts = (
        rows.withColumn("_place", place)
        .where("_place IS NOT NULL")
        .groupBy(*keys, "_place", F.when(F.col("_place") == 1, v).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_total").alias("_total"))
    )
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_place", "_v").rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("_upto", upto)
    middle = (F.col("_upto") >= F.floor((total + 1) / 2)) & (F.col("_upto") - F.col("_n") < F.floor(total / 2) + 1)
    outside = F.raise_error(F.lit("a median outside its bounds")).cast("double")
    counts = counts.where((F.col("_place") == -1) | middle)
    return counts.groupBy(*keys).agg(
        F.when(F.min("_place") == 0, outside).otherwise((F.min("_v") + F.max("_v")) / 2).alias("median")
    )


def group_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, mean: the mean of the non-NULL values as doubles, whatever their size.

    Sums of doubles depend on the order of rows in their last digits; round where that matters.
    """
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("mean"))


def _once(stats: DataFrame) -> DataFrame:
    """The same rows, kept where they are worked out, as the numbering reads them three times.

    Lost parts are worked out again. The literal makes the plan one of its own, so that no later query meets
    these rows after its tables have changed.
    """
    return stats.withColumn("_call", F.lit(uuid.uuid4().hex)).persist().drop("_call")


def _numbered(stats: DataFrame, *order: str, ranges: int = _RANGES) -> DataFrame:
    """Level numbers over one row per label, by some columns in rising order, missing values last.

    A window over all labels would bring them into one task. Bounds from a fixed number of labels, those
    with the smallest hashes, cut them into ranges; each range counts its labels and numbers them by
    itself, and the counts of the ranges before it are added.
    """
    keys = {f"_o{i}": c for i, c in enumerate(x for name in order for x in (F.col(name).isNull(), F.col(name)))}
    keyed = _once(stats).withColumn("_key", F.struct(*[c.alias(n) for n, c in keys.items()]))
    sample = keyed.orderBy(F.xxhash64("_key")).limit(ranges)
    bounds = sample.agg(F.array_sort(F.collect_list("_key"))).scalar()
    placed = keyed.withColumn("_bounds", bounds)
    placed = placed.withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_bounds")
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_count"))
    # A count per range, whatever the number of labels.
    counted = counts.agg(F.collect_list(F.struct("_range", "_count"))).scalar()
    local = F.row_number().over(W.partitionBy("_range").orderBy("_key"))
    numbered = placed.withColumn("_local", local).withColumn("_counted", counted)
    earlier = F.filter("_counted", lambda c: c["_range"] < F.col("_range"))
    level = F.aggregate(earlier, F.col("_local").cast("bigint"), lambda n, c: n + c["_count"])
    return numbered.select(*stats.columns, level.cast("int").alias("level"))


def level_order(df: DataFrame, label: str, value: str, stat: str = "median") -> DataFrame:
    """label, stat, level: labels by a statistic of their values, ties by name.

    Labels without any value come after the others, a NULL label last of all.
    """
    if stat == "median":
        stats = exact_median(df, [label], value)
    elif stat == "mean":
        stats = group_mean(df, [label], value)
    else:
        raise ValueError(f"unknown statistic: {stat}")
    missing = stats.withColumn("_missing", F.col(label).isNull())
    return _numbered(missing, "_missing", stat, label).drop("_missing")


def with_levels(df: DataFrame, label: str, value: str, stat: str = "median") -> DataFrame:
    """Every row with the level of its label."""
    levels = level_order(df, label, value, stat).select(F.col(label).alias("_label"), "level")
    return df.join(levels, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")


def fixed_order(df: DataFrame, label: str, front: Sequence[str], behind: DataFrame | None = None) -> DataFrame:
    """label, level: the given labels first, in that order, and all others behind.

    The others keep the order of ``behind``, a table of label and level such as another order gives, with
    labels that it lacks last; without it they go by name.
    """
    place = F.nullif(F.array_position(F.array(*map(F.lit, front)), F.col(label)), F.lit(0))
    labels = df.select(label).distinct().withColumn("_front", place)
    if behind is None:
        return _numbered(labels, "_front", label).drop("_front")
    earlier = behind.select(F.col(label).alias("_label"), F.col("level").alias("_behind"))
    labels = labels.join(earlier, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    return _numbered(labels, "_front", "_behind", label).drop("_front", "_behind")


def first_seen_order(df: DataFrame, label: str, ordinal: str) -> DataFrame:
    """label, first_seen, level: labels by the smallest ordinal they occur at; ties by name, NULL last."""
    seen = df.groupBy(label).agg(F.min(ordinal).alias("first_seen"))
    return _numbered(seen, "first_seen", label)


def alphabetical_order(df: DataFrame, label: str) -> DataFrame:
    """label, level: labels by name, in code-point order."""
    return _numbered(df.select(label).distinct(), label)
