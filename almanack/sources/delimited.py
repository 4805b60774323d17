"""Delimited yearly files whose headers drift.

One ``spark.read.csv`` over files with different headers applies the first header to all of
them and shifts columns silently. Here one job looks at all files: the first line of each, and where quoted
cells hold line breaks (``records``). Only the distinct headers reach the driver. All records are then parsed in
one scan, each under the header of its file, and laid side by side by repaired name. So neither jobs nor
plan grow with the number of files.
"""

from __future__ import annotations

import csv
import re
import urllib.parse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.functions.numbers import to_number
from almanack.sources.headers import clean_names
from almanack.sources.lookups import literal_table
from almanack.sources.records import records, scan_lines
from almanack.functions.types import guessed_types, united_types, with_types

#: Distinct headers that one reading may have; each is a branch of the parser.
MOST_HEADERS = 500
#: Files that an error message names.
NAMED = 20


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths matching a glob, on whatever file system the session reads.

    Only the path column is asked for, so no file content is loaded.
    """
    found = spark.read.format("binaryFile").load(pattern).select("path")
    return sorted(r.path for r in found.collect())


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path leads to files; Spark looks it up without a job."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def _cells(line: str, sep: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff")], delimiter=sep, strict=True), [])


class NothingToRead(ValueError):
    """There are files, but none of them has a line."""


@dataclass
class Reading:
    """Rows of delimited files, and the records that have no place among them."""

    rows: DataFrame  # _file, _name and the united columns
    bad: DataFrame  # file, record, reason
    headers: list[list[str]]  # the names of each header, in the order of their first files
    files: DataFrame  # file: those with at least a header

    def per_file(self) -> DataFrame:
        """file, rows, bad: how many records of each file were read and how many set aside."""
        good = self.rows.select(F.col("_file").alias("file"), F.lit(1).alias("rows"), F.lit(0).alias("bad"))
        both = good.unionByName(self.bad.select("file", F.lit(0).alias("rows"), F.lit(1).alias("bad")))
        return both.groupBy("file").agg(F.sum("rows").alias("rows"), F.sum("bad").alias("bad"))


def read_records(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = "\t",
    case: str | None = "upper_camel",
    strict: bool = False,
    types: str | None = None,
) -> Reading:
    """All records of some files, or of a glob, under the header of their file, in one scan.

    Cells are text; empty cells and the text NA are missing. ``case`` repairs names, None keeps them. ``types``
    pins every column by its position: n number, c text. If ``strict``, records with more or fewer cells than their
    header and those behind a quote that is never closed are bad; else the first are cut or filled up, and
    the second raise an error.
    """
    scan = scan_lines(spark, paths, sep)
    if scan.torn and not strict:
        raise ValueError(f"{scan.torn} has a quote that is not closed")
    found = scan.ranges.groupBy("header").agg(F.min("file").alias("file"))
    found = found.orderBy("file").limit(MOST_HEADERS + 1).collect()
    if not found:
        raise NothingToRead(f"nothing to read under {paths}")
    if len(found) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers")
    try:
        names = [_cells(r.header, sep) for r in found]
    except csv.Error as e:
        raise ValueError(f"a header with a line break or an open quote: {e}") from e
    for r, header in zip(found, names, strict=True):
        if types is not None and len(header) != len(types):
            raise ValueError(f"{r.file} does not have {len(types)} columns")
    names = [header if case is None else clean_names(header, case) for header in names]
    headers = literal_table(spark, [(r.header, i) for i, r in enumerate(found)], "header string, number int")
    rows = records(scan).join(F.broadcast(headers), "header").where(F.col("torn") | (F.trim("record") != ""))

    options = {
        "sep": sep, "escape": '"', "multiLine": "true", "nullValue": "NA", "emptyValue": "NA",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": "bad",
    }
    parsed = {}
    for i, header in enumerate(names):
        schema = ", ".join([*(f"c{k} string" for k in range(len(header))), "bad string"])
        parsed[f"h{i}"] = F.when((F.col("number") == i) & ~F.col("torn"), F.from_csv("record", schema, options))
    rows = rows.select("file", "name", "record", "torn", *[c.alias(n) for n, c in parsed.items()])
    odd = F.coalesce(F.lit(None).cast("string"), *[F.col(f"{n}.bad") for n in parsed]).isNotNull()
    bad = F.col("torn") | odd if strict else F.lit(False)

    places: dict[str, tuple[str, list[tuple[Column, str]]]] = {}
    for i, header in enumerate(names):
        for k, name in enumerate(header):
            places.setdefault(name.lower(), (name, []))[1].append((F.col(f"h{i}.c{k}"), types[k] if types else "c"))
    united = []
    for name, cells in places.values():
        number = all(code == "n" for _, code in cells)
        united.append(F.coalesce(*[_parsed(c, "n" if number else "c") for c, _ in cells]).alias(name))
    reason = F.when(F.col("torn"), "a quote that is not closed").otherwise("more or fewer cells than the header")
    return Reading(
        rows.where(~bad).select(F.col("file").alias("_file"), F.col("name").alias("_name"), *united),
        rows.where(bad).select("file", "record", reason.alias("reason")),
        names,
        scan.ranges.select("file").distinct(),
    )


def read_checked(
    spark: SparkSession, paths: str | Sequence[str], sep: str = "\t", case: str = "upper_camel", most_bad: float = 0.01
) -> Reading:
    """As ``read_records``, with bad records set aside; files with more than a share of them raise an error."""
    reading = read_records(spark, paths, sep, case, strict=True)
    torn = reading.per_file().where(F.col("bad") > F.lit(most_bad) * (F.col("rows") + F.col("bad")))
    named = [f"{r.file} ({r.bad} of {r.rows + r.bad})" for r in torn.orderBy("file").limit(NAMED).collect()]
    if named:
        raise ValueError(f"files with too many bad records: {', '.join(named)}")
    return reading


def read_guessed(
    spark: SparkSession, paths: str | Sequence[str], sep: str = "\t", case: str = "upper_camel"
) -> tuple[DataFrame, DataFrame]:
    """Rows under types guessed over all files, and the report: file, column, type and filled cells."""
    rows = read_records(spark, paths, sep, case).rows
    report = guessed_types(rows.drop("_name"), ["_file"]).withColumnRenamed("_file", "file")
    return with_types(rows.drop("_file", "_name"), united_types(report)), report


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that lead to files; one look if all do."""
    try:
        spark.read.text(list(paths))
        return list(paths)
    except AnalysisException:
        return [p for p in paths if _exists(spark, p)]


def _named_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """_path, name for each given name and path, spelled as Spark spells the path of a file."""
    plain = {_plain(path): name for name, path in paths.items()}
    quoted = {urllib.parse.quote(path, safe="/:!$&'()*+,;=@~"): name for path, name in plain.items()}
    return literal_table(spark, list((plain | quoted).items()), "_path string, name string")


def _path_of(file: str) -> Column:
    return F.regexp_replace(file, "^file:/+", "/")


def _read_present(
    spark: SparkSession, paths: Mapping[str, str], *args: str | None, **kwargs: str | None
) -> tuple[Reading | None, list[str]]:
    """A reading of those of the named paths that hold anything, and the names of the others."""
    there = _present(spark, list(paths.values()))
    try:
        reading = read_records(spark, there, *args, **kwargs) if there else None
    except NothingToRead:
        reading = None
    if reading is None:
        return None, list(paths)
    named = _named_files(spark, paths)
    full = named.join(reading.files, F.col("_path") == _path_of("file"), "left_semi").select("name").distinct()
    empty = literal_table(spark, [(n,) for n in paths], "name string").join(full, "name", "left_anti")
    lacking = {r["name"] for r in empty.collect()}  # of the caller's own names
    return reading, [n for n in paths if n in lacking]


def read_years(
    spark: SparkSession,
    paths: Sequence[str],
    sep: str = "\t",
    case: str = "upper_camel",
    origin: str | None = None,
) -> tuple[DataFrame | None, list[str]]:
    """Unite yearly files by repaired name; also return the paths that could not be read.

    Every column is text; casting is the caller's step. ``origin`` names a column that
    receives each row's file name. Missing and empty files are skipped and reported, other failures are raised.
    """
    reading, skipped = _read_present(spark, {p: p for p in paths}, sep, case)
    if reading is None:
        return None, skipped
    rows = reading.rows.drop("_file")
    return rows.drop("_name") if origin is None else rows.withColumn(origin, F.col("_name")).drop("_name"), skipped


def read_glob(
    spark: SparkSession, directory: str, pattern: str, sep: str = "\t", case: str = "upper_camel"
) -> DataFrame:
    """All files of a directory matching a glob, as one frame with repaired headers.

    Neither jobs nor anything on the driver grow with the number of files. Empty files give no rows.
    """
    return read_records(spark, f"{directory}/{pattern}", sep, case).rows.drop("_file", "_name")


def read_with_origin(
    spark: SparkSession, paths: Sequence[str], origin: str = "year", sep: str = "\t"
) -> DataFrame:
    """Several files in one frame, each row tagged with its file name."""
    df, skipped = read_years(spark, paths, sep, origin=origin)
    if df is None or skipped:
        raise ValueError(f"unreadable files: {skipped or list(paths)}")
    return df


def _parsed(c: Column, code: str) -> Column:
    if code == "c":
        return c
    digits = F.nullif(F.regexp_extract(c, r"-?(\d[\d,]*)?\.?\d+", 0), F.lit(""))
    return to_number(F.replace(digits, F.lit(","), F.lit("")))


def read_typed(spark: SparkSession, path: str, types: str, sep: str = ",") -> DataFrame:
    """One file with its header kept and types pinned by position: n number, c text."""
    return read_records(spark, [path], sep, None, types=types).rows.drop("_file", "_name")


def read_typed_years(
    spark: SparkSession, paths: Mapping[str, str], types: str, sep: str = ","
) -> tuple[DataFrame | None, list[str]]:
    """Typed yearly files tagged with their ``year``, in one scan; also the years without a file."""
    reading, skipped = _read_present(spark, paths, sep, None, types=types)
    if reading is None:
        return None, skipped
    named = _named_files(spark, paths).withColumnRenamed("name", "year")
    rows = reading.rows.join(F.broadcast(named), _path_of("_file") == F.col("_path"))
    return rows.drop("_file", "_name", "_path"), skipped
