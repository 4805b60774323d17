from almanack.operators.filters import (
    Geography,
    at_latest,
    chain_latest,
    geo_column,
    in_geography,
    matches_any,
    first_by,
)
from almanack.operators.joins import codebook_definitions, group_names
from almanack.operators.ordering import (
    alphabetical_order,
    exact_median,
    fixed_order,
    first_seen_order,
    group_mean,
    level_order,
    with_levels,
)
from almanack.operators.reshape import (
    columns_between,
    columns_from,
    found_names,
    lengthen,
    numbers_in,
    share_of_total,
    widen,
    widen_found,
)
from almanack.operators.sums import (
    distinct_values,
    group_sums,
    measure_by_year,
    pooled_rate,
    sums_by_name,
    with_group_sums,
)
from almanack.operators.unions import append_series, empty_like, stack

__all__ = [
    "Geography",
    "alphabetical_order",
    "append_series",
    "at_latest",
    "chain_latest",
    "codebook_definitions",
    "columns_between",
    "columns_from",
    "distinct_values",
    "empty_like",
    "exact_median",
    "first_by",
    "first_seen_order",
    "fixed_order",
    "found_names",
    "geo_column",
    "group_mean",
    "group_names",
    "group_sums",
    "in_geography",
    "lengthen",
    "level_order",
    "matches_any",
    "measure_by_year",
    "numbers_in",
    "pooled_rate",
    "share_of_total",
    "stack",
    "sums_by_name",
    "widen",
    "widen_found",
    "with_group_sums",
    "with_levels",
]
