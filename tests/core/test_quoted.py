"""Quoted text files cut at any byte against a reader that takes them whole."""

import csv
import random

import pytest

from fieldcanon.sources import quoted, tables


def own_reader(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def splits(spark):
    """Splits of so many bytes, until the test ends."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_rows(rng, n):
    letters = ["a", "é", "中", '"', '""', "\n", "\n\n", "\r\n", ",", ",,", " ", "'", '",\n"', "x" * 30]
    return [[str(k), "".join(rng.choices(letters, k=rng.randint(0, 6))), rng.choice(["plain", "", "two\nlines", 'say "x"', '5" pipe'])] for k in range(n)]


def save(path, rows, end, plain=False):
    # Spark takes the first line break that it sees for the one that ends records.
    head = ["id", "some\nvalue" if end == "\n" else "some value", "other"]
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([head, *rows])
        if plain:
            f.write(f'9000,a 5" b,c{end}9001,5",6"{end}9002,"q",""{end}')


@pytest.mark.parametrize("size, end", [(16, "\n"), (64, "\r\n"), (333, "\n"), (10_000_000, "\r\n")])
def test_any_border(spark, splits, tmp_path, size, end):
    rng = random.Random(size)
    save(tmp_path / "a.csv", odd_rows(rng, 8 if size == 16 else 60), end, plain=True)
    # Where records end with both characters, Spark reads both as one inside quotes too; here they stay.
    same = lambda rows: [tuple(v and v.replace("\r\n", "\n") for v in r) if end == "\r\n" else r for r in rows]
    want = same(rows_of(own_reader(spark, str(tmp_path / "a.csv"))))
    splits(size)
    got = quoted.read_quoted(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["id", "some\nvalue" if end == "\n" else "some value", "other"]
    assert sorted(same(rows_of(got)), key=str) == sorted(want, key=str)
    if size < 1000:
        assert quoted._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 4


def test_a_record_over_many_splits_and_many_files(spark, splits, tmp_path):
    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for k in range(3):
        save(folder / f"{k}.csv", [["1", '"\n' * 150 + "end", str(k)], ["2", "\n" * 90, "y"], ["3", "", ""]], "\n")
    want = rows_of(own_reader(spark, str(folder)))
    splits(50)
    assert rows_of(quoted.read_quoted(spark, str(folder))) == want and len(want) == 9


@pytest.mark.parametrize("content", ["a,b\n", "a,b", "\n\na,b\n\n1,2\n\n", 'a,b\n"open,\nand never closed', "﻿a,b\n1,2\n", "a,a,\n1,2,3,4\n5\n", '"a"\n"x"\n'])
def test_odd_files(spark, splits, tmp_path, content):
    path = tmp_path / "x.csv"
    path.write_bytes(content.encode())
    want = own_reader(spark, str(path))
    splits(3)
    got = quoted.read_quoted(spark, str(path))
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_ways_of_reading(spark, tmp_path):
    save(tmp_path / "a.csv", [["1", "x", "NA"], ["2", "y", "z"]], "\n")
    for breaks in ("split", "file"):
        df = tables.read_table(spark, str(tmp_path / "a.csv"), breaks=breaks)
        assert rows_of(df) == [("1", "x", None), ("2", "y", "z")]
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    assert rows_of(tables.read_table(spark, str(tmp_path / "b.csv"), breaks="none")) == [("1", "2")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "a.csv"), breaks="maybe")


def test_states_of_lines():
    for line, outside, inside in [("a,b", False, True), ('a,"b', True, False), ('a,b"', False, False), ('"', True, False), ('""', False, True), ('"",', False, True), ('x"",y', False, True), ('",",', False, True), (',"""', True, False)]:
        assert (quoted.ends_inside(line, False), quoted.ends_inside(line, True)) == (outside, inside), line
