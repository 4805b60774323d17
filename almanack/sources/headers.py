"""Column-name repair: yearly files spell the same column differently."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits stay with the word before them (NoStud5, Perc5b) unless a new word follows
# (Total12Months), so UpperCamel names convert to the same snake_case as the originals.
_WORD = re.compile(
    r"[A-Z]+(?![a-z])[0-9]*"
    r"|[A-Z]?[a-z]+(?:[0-9]+(?![0-9A-Z])[a-z0-9]*)?"
    r"|[A-Z][0-9]*"
    r"|[0-9]+[a-z]*"
)
# Signs that are spelled out instead of being dropped.
_SIGNS = {"%": " percent ", "#": " number "}


def _words(name: str) -> list[str]:
    for sign, word in _SIGNS.items():
        name = name.replace(sign, word)
    name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return _WORD.findall(name.replace("'", "").replace('"', ""))


def clean_names(names: Sequence[str], case: str = "upper_camel") -> list[str]:
    """Repaired names in one case; repeats (ignoring case) get the suffix _2, _3, ..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        words = _words(name)
        if case == "upper_camel":
            new = "".join(w.capitalize() for w in words)
            new = f"X{new}" if new[:1].isdigit() else new or "X"
        elif case == "snake":
            new = "_".join(w.lower() for w in words)
            new = f"x{new}" if new[:1].isdigit() else new or "x"
        else:
            raise ValueError(f"unknown case: {case}")
        n = seen[new.lower()] = seen.get(new.lower(), 0) + 1
        out.append(new if n == 1 else f"{new}_{n}")
    return out


def conform(df: DataFrame, case: str = "upper_camel") -> DataFrame:
    """The same rows under repaired column names."""
    return df.toDF(*clean_names(df.columns, case))


#: Digits of the codes that have a fixed width.
CODE_WIDTHS = {"county_code": 2, "district_code": 5}


def snake(df: DataFrame, codes: Sequence[str] = ()) -> DataFrame:
    """snake_case names, and code columns as text.

    Tables differ in naming and in whether a code is a number or text. Codes are compared
    as text, because a numeric comparison would accept "027" for 27. Numbers and short texts of
    county and district codes get their leading zeros, so 5 and "05" are one county.
    """
    df = conform(df, "snake")
    casts = {}
    for name in codes:
        if name not in df.columns:
            continue
        c = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("bigint")
        c, width = c.cast("string"), CODE_WIDTHS.get(name, 0)
        casts[name] = F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c) if width else c
    return df.withColumns(casts) if casts else df


def adopt_header(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename by position; the widths must agree."""
    if len(df.columns) != len(names):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def below_header(
    df: DataFrame,
    ordinal: str,
    header_row: int,
    names: Sequence[str],
    last_row: int | None = None,
) -> DataFrame:
    """Data rows of a sheet range: everything after its header row, up to its last row.

    A staged sheet carries its row number in ``ordinal``, since a distributed read has no
    file position.
    """
    keep = F.col(ordinal) > header_row
    if last_row is not None:
        keep = keep & (F.col(ordinal) <= last_row)
    return adopt_header(df.where(keep).drop(ordinal), names)
