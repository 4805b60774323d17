"""Text cleaning and display labels."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.logic import _col, match_value
from almanack.functions.numbers import first_number

# First letter of a reporting category -> family shown as a facet.
CATEGORY_FAMILIES = {"G": "Gender", "R": "Race/Ethnicity", "S": "Student Group"}


def first_letter(c: Column | str) -> Column:
    """First letter anywhere in the text; NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"\p{L}", 0), F.lit(""))


def category_family(c: Column | str) -> Column:
    """Family of a reporting category; NULL for totals and unknown families."""
    return match_value(first_letter(c), CATEGORY_FAMILIES)


def academic_year_label(c: Column | str) -> Column:
    """"reclass19.txt" to "2018-2019": the one 1-2 digit number is the closing year.

    Both halves are padded, so a closing year of 10 reads 2009-2010.
    """
    closing = first_number(c)
    return F.concat(
        F.lit("20"),
        F.lpad((closing - 1).cast("string"), 2, "0"),
        F.lit("-20"),
        F.lpad(closing.cast("string"), 2, "0"),
    )


def percent_label(c: Column | str, accuracy: float = 1) -> Column:
    """Fraction to a percent text at an accuracy in percent, such as 1, 0.5 or 0.01.

    The value is expressed in whole accuracy steps, ties going to the even step, and the
    text is assembled from integers, so no float formatting is involved. An infinite value has
    no label.
    """
    step = Decimal(str(accuracy)).normalize()
    digits = max(0, -int(step.as_tuple().exponent))
    steps = F.rint(_col(c) / F.lit(accuracy / 100)).try_cast("bigint")
    size, unit = F.abs(steps) * int(step * 10**digits), 10**digits
    text = ((size - size % unit) / unit).cast("bigint").cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((size % unit).cast("string"), digits, "0"))
    return F.concat(F.when(steps < 0, "-").otherwise(""), text, F.lit("%"))


def comma_label(c: Column | str) -> Column:
    """Whole number with thousands separators, ties going to the even number."""
    return F.format_number(F.rint(_col(c).cast("double")), 0)


def title_case(c: Column | str) -> Column:
    """Capital at every word start; hyphens and brackets start a word, apostrophes do not."""
    words = F.split(_col(c), r"(?<=[^\p{L}\p{N}'’])", -1)
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))),
        ),
        "",
    )


def place_name(c: Column | str, focus: str | None = None) -> Column:
    """Tidy place name; the focus county gets exactly one trailing "County"."""
    text = F.lower(_col(c))
    if focus is not None:
        short = focus.lower().removesuffix(" county")
        text = F.replace(text, F.lit(short), F.lit(f"{short} county"))
        text = F.replace(text, F.lit("county county"), F.lit("county"))
    return title_case(text)


def group_name(c: Column | str) -> Column:
    """Tidy group name; the two language abbreviations are whole words only."""
    text = title_case(c)
    text = F.regexp_replace(text, r"\bEo\b", "EO")
    return F.regexp_replace(text, r"\bEl\b", "ELs")
