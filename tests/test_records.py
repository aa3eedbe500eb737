import csv
import io
import random
from contextlib import contextmanager

import pandas as pd
import pytest

from pairscreen.sources import scans
from pairscreen.sources.records import quoted_records

HEADERS = list(scans.EXPORT_COLUMNS)
PARTS = ["a", ";", '"', "\n", "\r\n", "line", " x ", '";"', "\n\n", "5\" pipe", ""]


def cells(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))


def write(path, rows, header):
    text = io.StringIO()
    out = csv.writer(text, delimiter=";", quoting=csv.QUOTE_ALL, lineterminator="\n")
    out.writerows([header, *rows])
    path.write_bytes(text.getvalue().encode())


@contextmanager
def splits(spark, size):
    """Small splits while the files are read; what is written then is read back as usual."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def parsed(record):
    return tuple(next(csv.reader(io.StringIO(record, newline=""), delimiter=";")))


@pytest.mark.parametrize("size", [150, 1 << 20])
def test_records_equal_a_csv_reader(spark, tmp_path, size):
    rng, want = random.Random(size), []
    for i in range(3):
        rows = [[f"{i}-{n}", *[cells(rng) for _ in range(3)]] for n in range(40)]
        write(tmp_path / f"{i}.csv", rows, ["id", "broken\nheader", "x;y", "z"])
        want += [tuple(r) for r in rows]
    with splits(spark, size):
        got = quoted_records(spark, str(tmp_path))
    assert sorted(parsed(r["value"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("size", [20, 1000])
def test_stray_quotes_and_plain_lines(spark, tmp_path, size):
    """A quote inside an unquoted cell is text; files need no quotes at all."""
    (tmp_path / "a.csv").write_text("h;k\nplain;5\" pipe\n\nx;\"two\nlines\"\n  \n\"q\"tail;\"z\"\nlast;\"open\nto the end")
    (tmp_path / "b.csv").write_text("h;k\n" + "".join(f"r{i};s\r\n" for i in range(60)))
    (tmp_path / "c.csv").write_text("")
    with splits(spark, size):
        got = quoted_records(spark, str(tmp_path))
    assert sorted(r["value"] for r in got.collect()) == sorted(['plain;5" pipe', 'x;"two\nlines"', '"q"tail;"z"', 'last;"open\nto the end',
                                  *[f"r{i};s" for i in range(60)]])


def test_one_cell_over_many_splits(spark, tmp_path):
    long = "\n".join(f"line {i} ;\"" for i in range(300))
    write(tmp_path / "a.csv", [["1", "x"], ["2", long], ["3", "\n" * 50], ["4", "y"]], ["h", "k"])
    with splits(spark, 200):
        got = quoted_records(spark, str(tmp_path))
    assert sorted(parsed(r["value"]) for r in got.collect()) == [("1", "x"), ("2", long), ("3", "\n" * 50), ("4", "y")]


def test_many_cells_in_a_line(spark, tmp_path):
    """No recursion over cells or doubled quotes."""
    line = ";".join(['"a"'] * 100_000) + ';"' + '""' * 200_000 + '\nend"'
    (tmp_path / "a.csv").write_text(line + "\nnext;line\n")
    got = sorted(len(r["value"]) for r in quoted_records(spark, str(tmp_path), header=False).collect())
    assert got == [9, len(line)]


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_scan_compounds_with_line_breaks(spark, tmp_path, size):
    rng = random.Random(3)
    rows = [[f"C{n}", *[cells(rng) for _ in HEADERS[1:]], "extra"] for n in range(40)]
    path = tmp_path / "export.csv"
    write(path, rows, [*HEADERS, "Extra"])
    with open(path, "a") as f:
        f.write('"short";"one\nmore"\n')
    with splits(spark, size):
        got = scans.scan_compounds(spark, str(path), line_breaks=True)
    raw = pd.read_csv(path, sep=";", quotechar='"', usecols=HEADERS, dtype=str)
    blank = {"nan", "none", "null"}
    tidy = lambda v: "" if pd.isna(v) or v.strip().lower() in blank else v.strip()
    flat = lambda v: v.replace("\r\n", "\n")
    want = [tuple(flat(tidy(raw[h][i])) for h in HEADERS) for i in range(len(raw))]
    assert got.columns == list(scans.EXPORT_COLUMNS.values())
    assert sorted(tuple(flat(v) for v in r) for r in got.collect()) == sorted(want) and len(want) == 41
