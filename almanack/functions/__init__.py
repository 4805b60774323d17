from almanack.functions.labels import (
    academic_year_label,
    category_family,
    comma_label,
    first_letter,
    group_name,
    percent_label,
    place_name,
    title_case,
)
from almanack.functions.logic import (
    bucket_of,
    if_else,
    is_total_or_blank,
    mask_year,
    match_value,
    not_in,
    recode,
)
from almanack.functions.numbers import (
    first_number,
    per_hundred,
    per_thousand,
    round_half_away,
    share,
    strict_max,
    strict_sum,
    strip_separators,
    to_number,
    within_limits,
)
from almanack.functions.types import guessed_types, reconciled, united_types, widest, with_types

__all__ = [
    "academic_year_label",
    "bucket_of",
    "category_family",
    "comma_label",
    "first_letter",
    "first_number",
    "group_name",
    "guessed_types",
    "if_else",
    "is_total_or_blank",
    "mask_year",
    "match_value",
    "not_in",
    "per_hundred",
    "per_thousand",
    "percent_label",
    "place_name",
    "recode",
    "reconciled",
    "round_half_away",
    "share",
    "strict_max",
    "strict_sum",
    "strip_separators",
    "title_case",
    "to_number",
    "united_types",
    "widest",
    "with_types",
    "within_limits",
]
