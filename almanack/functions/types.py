"""Types guessed from text cells, and how types of different files go together.

The types form a lattice: a column without values fits every type, logical, number and date exclude one
another, and text takes everything. A column's type over several files is the least one that takes all of
them, so a year of numbers and a year with text make text.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.functions.numbers import to_number

EMPTY, LOGICAL, NUMBER, DATE, TEXT = "empty", "logical", "number", "date", "text"

# Spellings of a logical cell.
TRUE, FALSE = ["TRUE", "True", "true", "T"], ["FALSE", "False", "false", "F"]
# Plain decimal numbers with an optional exponent; separators of thousands make a cell text.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"

SQL_TYPES = {EMPTY: "string", LOGICAL: "boolean", NUMBER: "double", DATE: "date", TEXT: "string"}


def widest(types: Iterable[str]) -> str:
    """The least type that takes all the given ones."""
    some = {t for t in types if t != EMPTY}
    return EMPTY if not some else some.pop() if len(some) == 1 else TEXT


def _tests(cell: Column) -> dict[str, Column]:
    return {
        LOGICAL: cell.isin(TRUE + FALSE),
        NUMBER: cell.rlike(_NUMBER),
        DATE: cell.rlike(_DATE) & cell.try_cast("date").isNotNull(),
    }


def guessed_types(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """by, column, type, filled: what each text column holds, over all rows or per group, in one pass.

    Only counts per column are kept, combined map-side, so neither a wide file nor a large one makes a task grow.
    """
    columns = [c for c in df.columns if c not in by] if columns is None else list(columns)
    counts = []
    for i, name in enumerate(columns):
        cell = F.trim(F.col(f"`{name}`"))
        filled = cell.isNotNull() & (cell != "")
        counts.append(F.count_if(filled).alias(f"filled_{i}"))
        counts += [F.count_if(filled & test).alias(f"{kind}_{i}") for kind, test in _tests(cell).items()]
    rows = df.groupBy(*by).agg(*counts)
    kinds = [LOGICAL, NUMBER, DATE]

    def found(i: int) -> Column:
        kind = F.when(F.col(f"filled_{i}") == 0, EMPTY)
        for k in kinds:
            kind = kind.when(F.col(f"{k}_{i}") == F.col(f"filled_{i}"), k)
        return kind.otherwise(TEXT)

    cells = [
        F.struct(F.lit(name).alias("column"), found(i).alias("type"), F.col(f"filled_{i}").alias("filled"))
        for i, name in enumerate(columns)
    ]
    if not cells:
        return rows.select(*by, F.lit("").alias("column"), F.lit("").alias("type"), F.lit(0).alias("filled")).limit(0)
    return rows.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def united_types(report: DataFrame) -> dict[str, str]:
    """column -> type over all groups of a report; a row per column and type reaches the driver."""
    found: dict[str, list[str]] = {}
    for r in report.select("column", "type").distinct().collect():
        found.setdefault(r["column"], []).append(r["type"])
    return {name: widest(types) for name, types in found.items()}


def with_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Text columns under their types; columns that are not named stay as they are."""

    def cast(c: Column, kind: str) -> Column:
        cell = F.nullif(F.trim(c), F.lit(""))
        if kind == NUMBER:
            return to_number(cell)
        if kind == DATE:
            return cell.try_cast("date")
        if kind == LOGICAL:
            return F.when(cell.isin(TRUE), True).when(cell.isin(FALSE), False)
        return c

    return df.withColumns({name: cast(F.col(f"`{name}`"), kind) for name, kind in types.items()})


# ---------------------------------------------------------------- typed columns


def kind_of(t: T.DataType) -> str | None:
    """The place of a column type in the lattice; None for types it doesn't know."""
    if isinstance(t, T.NullType):
        return EMPTY
    if isinstance(t, T.BooleanType):
        return LOGICAL
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return TEXT
    return None


def as_text(c: Column, t: T.DataType) -> Column:
    """A typed column as text: whole numbers without decimals, logical values as TRUE and FALSE."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        whole = (F.abs(c) < 1e15) & (F.floor(c) == c)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(t, T.BooleanType):
        return F.upper(c.cast("string"))
    return c.cast("string")


def reconciled(frames: Sequence[DataFrame]) -> list[DataFrame]:
    """The frames with text in every column whose types exclude one another.

    A union would cast the text to the other type and fail on the first suppressed cell.
    """
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for f in frame.schema.fields:
            kind = kind_of(f.dataType)
            if kind not in (None, EMPTY):
                kinds.setdefault(f.name.lower(), set()).add(kind)
    unlike = {name for name, found in kinds.items() if len(found) > 1}
    out = []
    for frame in frames:
        mixed = [f for f in frame.schema.fields if f.name.lower() in unlike and kind_of(f.dataType) not in (None, TEXT)]
        casts = {f.name: as_text(F.col(f"`{f.name}`"), f.dataType) for f in mixed}
        out.append(frame.withColumns(casts) if casts else frame)
    return out
