"""UNION ALL by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from almanack.functions.types import reconciled


def stack(frames: Iterable[DataFrame | None]) -> DataFrame:
    """Unite frames by name; a column a frame lacks is NULL there. None is skipped.

    A column that is a number or a date in one frame and text in another is text in the result.
    """
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("no frame to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reconciled(present))


def empty_like(df: DataFrame) -> DataFrame:
    """A frame with the same columns and no rows, the start of an accumulation."""
    return df.limit(0)


def append_series(df: DataFrame, other: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Add a derived series under another source's names; other columns are left out.

    ``renames`` maps the target name to the name in ``other``.
    """
    return stack([df, other.select(*[other[old].alias(new) for new, old in renames.items()])])
