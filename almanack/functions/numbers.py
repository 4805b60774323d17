"""Casts, rates and rounding.

Spark runs in ANSI mode: a plain cast of ``*`` or a division by zero raises. Published
files hold suppressed cells and zero denominators, so everything here uses the ``try_``
forms and yields NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.logic import _col

# Doubles hold every whole number up to this bound; above it there are no decimals left.
_WHOLE = float(2**53)


def to_number(c: Column | str) -> Column:
    """Text to double; suppressed or malformed text gives NULL.

    Java number syntax allows a type suffix ("1d", "1f"), which is not a number in a
    published file, so such text is NULL as well. Looking at the first and last character
    also spares the costly failed parse of a suppressed cell.
    """
    text = F.trim(_col(c).cast("string"))
    number_like = F.left(text, F.lit(1)).isin(*"0123456789+-.") & ~F.right(text, F.lit(1)).isin(
        *"dDfF"
    )
    return F.when(number_like, text.try_cast("double"))


def strip_separators(c: Column | str) -> Column:
    """"1,234" to 1234.0."""
    return to_number(F.replace(_col(c), F.lit(","), F.lit("")))


def first_number(c: Column | str, digits: int = 2) -> Column:
    """The only run of 1..digits digits in a text, as an integer.

    No run gives NULL; a text with several runs is ambiguous and fails the job.
    """
    runs = F.regexp_extract_all(_col(c), F.lit(rf"(\d{{1,{digits}}})"), F.lit(1))
    return (
        F.when(F.size(runs) == 1, F.get(runs, F.lit(0)).try_cast("int"))
        .when(
            F.size(runs) > 1,
            F.raise_error(F.concat(F.lit("more than one number in: "), _col(c))).cast("int"),
        )
    )


def per_hundred(part: Column | str, whole: Column | str) -> Column:
    """Rate per 100; NULL on a zero denominator."""
    return F.try_divide(_col(part).cast("double") * 100, _col(whole).cast("double"))


def per_thousand(part: Column | str, whole: Column | str) -> Column:
    """Rate per 1,000; NULL on a zero denominator."""
    return F.try_divide(_col(part).cast("double") * 1000, _col(whole).cast("double"))


def share(part: Column | str, whole: Column | str) -> Column:
    """Part of a whole as a fraction; NULL on a zero denominator."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def round_half_away(c: Column | str, digits: int = 0) -> Column:
    """Round half away from zero in binary arithmetic.

    ``F.round`` works on the decimal print of the double and gives 0.29 for 0.285; scaling,
    adding a half and cutting off gives 0.28, which is what the published labels carry.
    """
    x = _col(c).cast("double")
    scale = float(10**digits)
    scaled = F.abs(x) * scale + 0.5
    cut = F.floor(scaled).cast("double") / scale * F.signum(x)
    return F.when(scaled < _WHOLE, cut).otherwise(x)


def strict_sum(c: Column | str) -> Column:
    """Aggregate: sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(_col(c)) == F.count(F.lit(1)), F.sum(_col(c)))


def strict_max(c: Column | str) -> Column:
    """Aggregate: maximum that is NULL as soon as one input is NULL."""
    return F.when(F.count(_col(c)) == F.count(F.lit(1)), F.max(_col(c)))


def within_limits(c: Column | str, low: float, high: float) -> Column:
    """The value where an axis would show it, else NULL; the raw column stays untouched."""
    return F.when(_col(c).between(F.lit(low), F.lit(high)), _col(c))
