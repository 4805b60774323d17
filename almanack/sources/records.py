"""Records of delimited files whose quoted cells may hold line breaks, with every file read in byte ranges.

A line alone doesn't tell whether it starts a record: a quoted cell may still be open. So each line is taken as a
function from "open before" to "open behind". Nearly all lines leave the state as it is or set it, whatever it was; a few
turn it round. The functions of a byte range compose to one function, and a prefix over the ranges of a file (a row per
range) gives the state that each range starts with. Only ranges in which a cell is open somewhere are then looked at
line by line; the lines of their broken records are put together, all other lines are records as they stand.

A quote opens a cell only where the cell starts and closes it unless it is doubled, as in Python's ``csv``.
The place of a line is its order in the scan, so both scans have to cut files alike; a line of an unknown range
fails the job. Lines end with \\n or \\r\\n.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanack.folders import stored

#: Rows of a table of files or byte ranges that may be broadcast; each takes some hundred bytes.
BROADCAST_ROWS = 50_000


def line_states(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open behind a line (0 or 1), if none was open before it and if one was.

    The patterns are possessive, so they don't go back over a line, however long its cells are.
    """
    s = sep if sep.isalnum() else "\\" + sep
    body = '[^"]*+(?:""[^"]*+)*+'
    cell = f' *+(?:"{body}"[^{s}]*+|[^"{s} ][^{s}]*+|)'
    opening = f'^(?:{cell}{s})*+ *+"{body}\\z'
    opened = lambda text: text.rlike(opening).cast("int")
    rest = F.regexp_replace(line, f'^{body}"[^{s}]*+(?:{s}|\\z)', "")
    quoted = line.contains('"')
    behind_open = F.when(~quoted | ~line.rlike(f'^{body}"'), 1).otherwise(opened(rest))
    return F.when(quoted, opened(line)).otherwise(0), behind_open


@dataclass
class Scan:
    """The lines of some files, and what is known of each byte range of them."""

    lines: DataFrame  # file, name, block, place, line
    ranges: DataFrame  # file, block, before, broken, torn, header, first
    sep: str
    broken: bool
    torn: str | None  # one of the files that end inside a quoted cell
    small: bool

    def joined(self, frame: DataFrame, other: DataFrame, how: str) -> DataFrame:
        return frame.join(F.broadcast(other) if self.small else other, ["file", "block"], how)


def scan_lines(spark: SparkSession, paths: str | Sequence[str], sep: str) -> Scan:
    """Look at all lines once, in one job; the result has a row per byte range."""
    raw = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.rtrim("value", F.lit("\r")).alias("line"),
    )
    shut, open_ = line_states(F.col("line"), sep)
    states = lines.withColumns({"shut": shut, "open": open_})
    ranges = states.groupBy("file", "block").agg(
        F.max(F.when(F.col("shut") == F.col("open"), F.struct("place", "shut"))).alias("set"),
        F.collect_list(F.when(F.col("shut") > F.col("open"), F.col("place"))).alias("turns"),
        F.max("shut").alias("opens"),
        F.min("place").alias("first"),
        F.min_by("line", "place").alias("top"),
    )
    later = F.filter("turns", lambda p: F.col("set").isNull() | (p > F.col("set.place")))
    turned = F.size(later) % 2
    ranges = ranges.select(
        "file", "block", "opens", "first", "top", turned.alias("turned"),
        F.when(F.col("set").isNotNull(), (F.col("set.shut") + turned) % 2).alias("sets"),
    )
    whole, upto = W.partitionBy("file"), W.partitionBy("file").orderBy("block")
    earlier = upto.rowsBetween(W.unboundedPreceding, -1)
    own_turn = F.when(F.col("sets").isNull(), F.col("turned")).otherwise(0)
    ranges = ranges.withColumn("turns", F.sum(own_turn).over(upto))
    last_set = F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", "turns")), True).over(earlier)
    ranges = ranges.withColumn("last_set", last_set).withColumn("own_turn", own_turn)
    before = F.coalesce(F.col("last_set.sets"), F.lit(0)) + F.col("turns") - F.col("own_turn")
    ranges = ranges.withColumn("before", ((before - F.coalesce(F.col("last_set.turns"), F.lit(0))) % 2).cast("int"))
    behind = F.coalesce("sets", (F.col("before") + F.col("turned")) % 2)
    ranges = ranges.select(
        "file",
        "block",
        "before",
        ((F.col("before") == 1) | (F.col("opens") == 1)).alias("broken"),
        (F.max_by(behind, "block").over(whole) == 1).alias("torn"),
        F.min_by("top", "block").over(whole).alias("header"),
        F.when(F.col("block") == F.min("block").over(whole), F.col("first")).alias("first"),
    )
    ranges = stored(ranges, "byte-ranges")
    found = ranges.agg(F.count("*"), F.coalesce(F.max("broken"), F.lit(False)), F.min(F.when(F.col("torn"), F.col("file"))))
    count, broken, torn = found.first()
    return Scan(lines, ranges, sep, broken, torn, count <= BROADCAST_ROWS)


def records(scan: Scan) -> DataFrame:
    """file, name, header, record, torn: all records but the headers.

    The lines behind the last quote that a torn file doesn't close are rows of their own, marked as torn.
    """
    known = scan.ranges.withColumn("known", F.lit(True))
    lines = scan.joined(scan.lines, known, "left")
    lines = lines.where(F.coalesce("known", F.raise_error(F.lit("the files were cut differently in the two scans")).cast("boolean")))
    body = ~F.col("place").eqNullSafe(F.col("first"))
    whole = lines.where(body & ~F.col("broken")).select("file", "name", "header", F.col("line").alias("record"), F.lit(False).alias("torn"))
    if not scan.broken:
        return whole
    shut, open_ = line_states(F.col("line"), scan.sep)
    inner = lines.where("broken").withColumns({"shut": shut, "open": open_})
    upto = W.partitionBy("file", "block").orderBy("place")
    turn = (F.col("shut") > F.col("open")).cast("int")
    inner = inner.withColumn("turns", F.sum(turn).over(upto))
    last_set = F.last(F.when(F.col("shut") == F.col("open"), F.struct("shut", "turns")), True)
    inner = inner.withColumn("set", last_set.over(upto.rowsBetween(W.unboundedPreceding, -1)))
    state = F.coalesce(F.col("set.shut"), F.col("before")) + F.col("turns") - turn - F.coalesce(F.col("set.turns"), F.lit(0))
    inner = inner.withColumn("inside", state % 2 == 1)
    alone = ~F.col("inside") & (F.col("shut") == 0)
    singles = inner.where(alone & body).select("file", "name", "header", F.col("line").alias("record"), F.lit(False).alias("torn"))

    # The lines of a broken record go by the place of the line that opens it, maybe in an earlier range.
    parts = inner.where(~alone)
    opener = F.when(~F.col("inside"), F.struct("block", "place"))
    parts = parts.withColumn("own", F.last(opener, True).over(upto))
    openers = parts.groupBy("file", "block").agg(F.max(opener).alias("last"))
    by_block = W.partitionBy("file").orderBy("block")
    openers = openers.select(
        "file",
        "block",
        F.last("last", True).over(by_block.rowsBetween(W.unboundedPreceding, -1)).alias("carried"),
        F.max("last").over(W.partitionBy("file")).alias("newest"),
    )
    parts = scan.joined(parts, openers, "left").withColumn("start", F.coalesce("own", "carried"))
    unclosed = F.col("torn") & (F.col("start") == F.col("newest"))
    lost = parts.where(unclosed).select("file", "name", "header", F.col("line").alias("record"), "torn")
    joined = parts.where(~unclosed & ~F.col("start.place").eqNullSafe(F.when(F.col("block") == F.col("start.block"), F.col("first"))))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "line"))), lambda x: x["line"])
    joined = joined.groupBy("file", "name", "header", "start").agg(F.array_join(texts, "\n").alias("record"))
    joined = joined.select("file", "name", "header", "record", F.lit(False).alias("torn"))
    return whole.unionByName(singles).unionByName(joined).unionByName(lost)
