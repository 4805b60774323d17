import csv
import datetime
import io
import random

import pytest
from almanack.functions import guessed_types, united_types, widest, with_types
from almanack.operators import stack
from almanack.sources import read_checked, read_glob, read_guessed, read_records, read_typed_years, read_years
from almanack.sources.records import records, scan_lines
from pyspark.sql import functions as F


@pytest.fixture
def ranges(spark):
    """Byte ranges of 60 bytes, so that small files are cut often."""
    names = {"spark.sql.files.maxPartitionBytes": "60", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def table(seed, rows, sep):
    """Random cells with breaks, doubled quotes, separators and quotes inside plain cells."""
    rng = random.Random(seed)
    kinds = ["plain", "7", "two\nlines", 'a "word" said', f"x{sep}y", "", "\n", 'end"', '5" pipe', "a\n\nb\n", f'"{sep}"\n"', "long " * 30, "tail\r\nof it"]
    return [[rng.choice(kinds) for _ in range(3)] for _ in range(rows)]


def written(rows, sep, seed=0):
    """CSV text; cells that need no quotes get some now and then."""
    rng, out = random.Random(seed), []
    for row in rows:
        cells = []
        for c in row:
            need = any(x in c for x in (sep, "\n", "\r")) or c.startswith('"')
            cells.append('"' + c.replace('"', '""') + '"' if need or rng.random() < 0.3 else c)
        out.append(sep.join(cells))
    return "\n".join(out) + "\n"


def by_csv(text, sep):
    return sorted(tuple(c.strip(" \t") or None for c in r) for r in list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[1:] if any(c.strip() for c in r) or len(r) > 1)


def found(df, *columns):
    return sorted((tuple(None if c is None else c for c in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("sep", [",", "\t"])
def test_records_cut_in_many_ranges_equal_csv(ranges, tmp_path, sep):
    want, names = [], []
    for seed in range(4):
        rows = [["a", "b", "c"], *table(seed, 60, sep)]
        text = written(rows, sep, seed)
        (tmp_path / f"f{seed}.txt").write_text(text, newline="")
        names.append(f"{tmp_path}/f{seed}.txt")
        want += list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))[1:]
    scan = scan_lines(ranges, names, sep)
    assert scan.broken and scan.torn is None and scan.ranges.count() > 40
    got = records(scan).select("record", "torn").collect()
    assert not any(r["torn"] for r in got)
    again = [next(csv.reader(io.StringIO(r["record"], newline=""), delimiter=sep)) for r in got if r["record"]]
    clean = lambda rows: sorted(str([c.replace("\r\n", "\n") for c in r]) for r in rows)
    assert clean(again) == clean(r for r in want if r)


def test_cells_equal_csv(ranges, tmp_path):
    rows = [["Year", "Note", "n"], ["A", "two\nlines", "1"], ["B", 'said "so",\nand went', "2"], ["C", "x,y", "3"], ["D", '5" pipe', "4"], ["E", "", "NA"]]
    (tmp_path / "t.txt").write_text("﻿" + written(rows, ","), newline="")
    got = read_records(ranges, f"{tmp_path}/t.txt", ",").rows
    assert found(got, "Year", "Note", "N") == [
        ("A", "two\nlines", "1"), ("B", 'said "so",\nand went', "2"), ("C", "x,y", "3"), ("D", '5" pipe', "4"), ("E", None, None),
    ]


def test_records_over_several_ranges(ranges, tmp_path):
    cell = "\n".join(f"line {i} of a long cell" for i in range(50))
    (tmp_path / "t.txt").write_text(f'a,b\n1,"{cell}"\n2,x\n3,"{cell}"\n', newline="")
    got = read_records(ranges, [f"{tmp_path}/t.txt"], ",", None).rows
    assert found(got, "a", "b") == [("1", cell), ("2", "x"), ("3", cell)]


def test_open_quotes_raise_or_are_set_aside(ranges, tmp_path):
    (tmp_path / "torn.txt").write_text('a,b\n1,x\n2,"never\nclosed\n3,y\n')
    (tmp_path / "good.txt").write_text('a,b\n4,"two\nlines"\n5,z\n6,too,many\n7\n')
    with pytest.raises(ValueError, match="torn.txt has a quote that is not closed"):
        read_records(ranges, f"{tmp_path}/*.txt", ",", None)
    with pytest.raises(ValueError, match=r"good.txt \(2 of 4\), .*torn.txt \(3 of 4\)"):
        read_checked(ranges, f"{tmp_path}/*.txt", ",", None, most_bad=0.4)
    reading = read_checked(ranges, f"{tmp_path}/*.txt", ",", None, most_bad=0.8)
    assert found(reading.rows, "a", "b") == [("1", "x"), ("4", "two\nlines"), ("5", "z")]
    bad = sorted((r.file.rpartition("/")[2], r.record, r.reason) for r in reading.bad.collect())
    assert bad == [
        ("good.txt", "6,too,many", "more or fewer cells than the header"), ("good.txt", "7", "more or fewer cells than the header"),
        ("torn.txt", '2,"never', "a quote that is not closed"), ("torn.txt", "3,y", "a quote that is not closed"), ("torn.txt", "closed", "a quote that is not closed"),
    ]
    counts = {r.file.rpartition("/")[2]: (r.rows, r.bad) for r in reading.per_file().collect()}
    assert counts == {"good.txt": (2, 2), "torn.txt": (1, 3)}
    # Without the check, a short record is filled up and a long one cut.
    got = read_records(ranges, f"{tmp_path}/good.txt", ",", None).rows
    assert found(got, "a", "b") == [("4", "two\nlines"), ("5", "z"), ("6", "too"), ("7", None)]
    (tmp_path / "head.txt").write_text('a,"b\nc"\n1,2\n')
    with pytest.raises(ValueError, match="header"):
        read_records(ranges, f"{tmp_path}/head.txt", ",", None)


def jobs_of(spark, tag, action):
    spark.sparkContext.setJobGroup(tag, tag)
    out = action()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    headers = ["Academic Year\tCharterYN\tn", "CharterYn\tAcademicYear\tn", "Academic Year\tn\tExtra"]
    for folder, count in (("few", 6), ("many", 2_000)):
        (tmp_path / folder).mkdir()
        for i in range(count):
            (tmp_path / folder / f"y{i}.txt").write_text(f"{headers[i % 3]}\nA{i}\tB{i}\t{i}\n")
    few, few_jobs = jobs_of(spark, "few", lambda: read_glob(spark, f"{tmp_path}/few", "*.txt"))
    many, many_jobs = jobs_of(spark, "many", lambda: read_glob(spark, f"{tmp_path}/many", "*.txt"))
    assert many_jobs <= few_jobs + 2 < 12  # Spark lists many files in a job of its own
    assert many.columns == few.columns == ["AcademicYear", "CharterYn", "N", "Extra"]
    assert (few.count(), many.count()) == (6, 2_000)
    row = many.where("AcademicYear = 'B1'").first()
    assert tuple(row) == ("B1", "A1", "1", None)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1


def test_typed_years_share_a_scan(spark, tmp_path):
    for year in (1, 2, 3):
        (tmp_path / f"y {year}.txt").write_text(f'CO,Text,Perc\n27,"Met, {year}\nof 6","1,23{year}"\n')
    (tmp_path / "y 4.txt").write_text("Perc,Text,CO\n5,x,28\n")
    paths = {f"20{y}": f"{tmp_path}/y {y}.txt" for y in (1, 2, 3, 4, 9)}
    rows, skipped = read_typed_years(spark, paths, "ncn")
    assert skipped == ["209"]
    assert found(rows, "year", "CO", "Text", "Perc") == [
        ("201", 27.0, "Met, 1\nof 6", 1231.0), ("202", 27.0, "Met, 2\nof 6", 1232.0), ("203", 27.0, "Met, 3\nof 6", 1233.0), ("204", 28.0, "x", 5.0),
    ]


# ---------------------------------------------------------------- types


def test_types_are_guessed_over_all_files(spark, tmp_path):
    (tmp_path / "y1.txt").write_text("Year\tRate\tDay\tFlag\tNone\tDrift\n2019\t1.5\t2019-02-28\tTRUE\tNA\t1\n2019\t-2e3\t2020-02-29\tF\t\t2\n")
    (tmp_path / "y2.txt").write_text("Drift\tYear\tRate\tDay\tFlag\tNone\n*\t2020\t.5\t2021-01-01\tT\tNA\n3\t2020\tNA\tNA\tNA\tNA\n")
    rows, report = read_guessed(spark, f"{tmp_path}/*.txt")
    assert dict(rows.dtypes) == {"Year": "double", "Rate": "double", "Day": "date", "Flag": "boolean", "None": "string", "Drift": "string"}
    got = {(r.file.rpartition("/")[2], r.column): (r.type, r.filled) for r in report.collect()}
    assert got["y1.txt", "Drift"] == ("number", 2) and got["y2.txt", "Drift"] == ("text", 2)
    assert got["y2.txt", "Rate"] == ("number", 1) and got["y1.txt", "None"] == ("empty", 0) and len(got) == 12
    assert found(rows, "Rate", "Drift") == sorted([(1.5, "1"), (-2000.0, "2"), (0.5, "*"), (None, "3")], key=str)
    assert rows.where("Day = DATE'2020-02-29' AND NOT Flag").count() == 1


def test_lattice():
    assert widest([]) == widest(["empty"]) == "empty"
    assert widest(["number", "empty"]) == "number" and widest(["number", "text"]) == "text" and widest(["date", "number"]) == "text"


def test_odd_cells_are_text(spark):
    df = spark.createDataFrame([("1,234", "2021-02-30", "1d", " 7 ", "t")], "a string, b string, c string, d string, e string")
    types = united_types(guessed_types(df))
    assert types == {"a": "text", "b": "text", "c": "text", "d": "number", "e": "text"}
    assert with_types(df, types).first()["d"] == 7.0
    assert united_types(guessed_types(df.where("false"))) == {c: "empty" for c in "abcde"}


def test_unlike_types_become_text_in_a_union(spark):
    numbers = spark.createDataFrame([(1, 5.0), (2, 2.5), (3, None)], "k int, v double")
    days = spark.createDataFrame([(4, datetime.date(2020, 2, 29))], "k int, V date")
    flags = spark.createDataFrame([(5, True)], "k int, v boolean")
    texts = spark.createDataFrame([(6, "*"), (7, "1,234")], "k int, v string")
    empty = spark.range(1).select(F.lit(8).alias("k"), F.lit(None).alias("v"))
    want = {1: "5", 2: "2.5", 3: None, 4: "2020-02-29", 5: "TRUE", 6: "*", 7: "1,234", 8: None}
    frames = [numbers, days, flags, texts, empty]
    for order in (frames, frames[::-1]):
        got = stack(order)
        assert dict(got.dtypes)["k"] == "int" and {r[0]: r[1] for r in got.select("k", "v").collect()} == want
    for pair in ([numbers, texts], [texts, numbers], [days, texts], [texts, days], [numbers, days], [days, numbers]):
        assert dict((a.lower(), b) for a, b in stack(pair).dtypes)["v"] == "string"
        assert stack(pair).count() == sum(f.count() for f in pair)
    assert dict(stack([numbers, empty]).dtypes)["v"] == "double"
    assert dict(stack([numbers, numbers.select("k", F.col("v").cast("int"))]).dtypes)["v"] == "double"


def test_missing_and_empty_among_many(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("x\ty\n")
    paths = [f"{tmp_path}/{n}.txt" for n in "abcd"]
    df, skipped = read_years(spark, paths)
    assert skipped == [paths[1], paths[3]] and found(df, "X", "Y") == [("1", "2")]
