import csv
import io
import random

import pytest

from sparkloom.sources import quoted, readers


def plain(text, delimiter=","):
    """All records by Python's reader of a whole text, as the library's rules fill and leave out rows."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r]
    n = len(rows[0])
    return sorted((tuple((v or None) for v in r[:n]) + (None,) * (n - len(r)) for r in rows[1:] if not any(r[n:])), key=repr)


def some_file(seed, rows=120, end="\n"):
    rng = random.Random(seed)
    parts = ["x", "yy", " ", '""', end, ",", "é", "zz zz", end * 2]
    out = ["a,b,c"]
    for k in range(rows):
        fields = []
        for _ in range(rng.choice((1, 2, 3, 3, 3, 3, 4))):
            kind = rng.random()
            if kind < 0.4:
                fields.append('"' + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + '"')
            else:
                fields.append(rng.choice(("plain", 'in"ner', "5\" pipe", "", "w w", '"q"tail')))
        out.append(",".join([f"k{k}", *fields[1:]]) if rng.random() < 0.9 else ",".join(fields))
    return end.join(out) + rng.choice(("", end))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_records_over_many_splits(spark, small_splits, seed, end):
    text = some_file(seed, end=end)
    path = readers.stored(spark, text, "input.csv")
    scanned, breaks, valid = quoted.scan_once(spark, path, ",")
    assert breaks and valid and scanned.count() > 20
    df = readers.read_csv(spark, path)
    assert df.rdd.getNumPartitions() > 20
    assert got(df) == plain(text)


def test_default_reads_quoted_breaks(spark):
    path = readers.stored(spark, 'id,note\n1,"two\nlines"\n2,x\n', "input.csv")
    assert got(readers.extract(spark, path)) == [("1", "two\nlines"), ("2", "x")]
    assert got(readers.read_csv(spark, path, multiline=True)) == [("1", "two\nlines"), ("2", "x")]
    assert len(got(readers.read_csv(spark, path, multiline=False))) == 3


def test_one_value_over_many_splits_and_latin(spark, small_splits):
    long = "\n".join(f"grün {i}" for i in range(100))
    text = f'a;b\n1;"{long}"\n2;"no"\n3;"it ""is"""\n'
    path = readers.stored(spark, text.encode("latin-1"), "input.csv")
    assert got(readers.read_csv(spark, path)) == [("1", long), ("2", "no"), ("3", 'it "is"')]


def test_quotes_without_breaks_go_to_the_fast_reader(spark):
    path = readers.stored(spark, 'a,b\n1,"x,y"\n2,5" pipe\n3,"a ""b"""\n', "input.csv")
    assert not quoted.scan_once(spark, path, ",")[1]
    assert got(readers.read_csv(spark, path)) == [("1", "x,y"), ("2", '5" pipe'), ("3", 'a "b"')]


def test_open_quote_at_the_end_and_empty_files(spark):
    assert got(readers.read_csv(spark, readers.stored(spark, 'a,b\n1,"open\nend\n', "input.csv"))) == [("1", "open\nend\n")]
    assert got(readers.read_csv(spark, readers.stored(spark, "a,b\n", "input.csv"))) == []
    assert readers.read_csv(spark, readers.stored(spark, "", "input.csv")).collect() == []


def test_several_files_have_headers_each(spark, small_splits, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f'﻿a,b\n{k},"x\n{k}"\n{k},"{"l\n" * 60}"\n', encoding="utf-8")
    assert got(readers.read_csv(spark, str(tmp_path))) == sorted([(str(k), v) for k in range(3) for v in (f"x\n{k}", "l\n" * 60)], key=repr)


def test_state_of_lines():
    for line, outside, inside in (("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('a""b', False, True), ('",', True, False), ('a,"b""', True, False), ('x","y', True, True), ('x,"y",', False, False)):
        assert (quoted.ends_inside(line, False, ","), quoted.ends_inside(line, True, ",")) == (outside, inside), line
