"""Conditions and replacements with explicit NULL rules.

All of these stay Column expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v: Any) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def if_else(condition: Column, yes: Any, no: Any) -> Column:
    """Two-way choice in which an unknown condition gives NULL, not ``no``."""
    return F.when(condition, _value(yes)).when(~condition, _value(no))


def match_value(c: Column | str, mapping: Mapping[Any, Any]) -> Column:
    """Value-by-value choice; anything unmatched becomes NULL."""
    out: Column | None = None
    for key, value in mapping.items():
        test = _col(c) == F.lit(key)
        out = F.when(test, _value(value)) if out is None else out.when(test, _value(value))
    return F.lit(None).cast("string") if out is None else out


def bucket_of(c: Column | str, buckets: Mapping[str, Iterable[Any]]) -> Column:
    """Name of the first bucket whose member list holds the value, else NULL."""
    out: Column | None = None
    for name, members in buckets.items():
        test = _col(c).isin(list(members))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def recode(c: Column | str, mapping: Mapping[Any, Any]) -> Column:
    """Replace listed values and keep every other value as it is."""
    return F.coalesce(match_value(c, mapping), _col(c))


def not_in(c: Column | str, values: Iterable[Any]) -> Column:
    """Complement of membership that keeps NULLs (SQL NOT IN would drop them)."""
    return ~F.coalesce(_col(c).isin(list(values)), F.lit(False))


def is_total_or_blank(c: Column | str, total: str = "All") -> Column:
    """True on total rows: the sentinel itself, or a year that left the column empty."""
    return (_col(c) == F.lit(total)) | _col(c).isNull() | (_col(c) == F.lit(""))


def mask_year(c: Column | str, year: Column | str, masked: str) -> Column:
    """Blank a measure in one year and keep it in all others."""
    return F.when(_col(year) != F.lit(masked), _col(c))
