"""CSV whose quoted values hold line breaks, read by many tasks.

A file is read as lines, in the splits that Spark makes. Whether a split begins within quotes depends on all that comes
before it, but each line, and so each split, is a function from (outside, inside) to (outside, inside). The splits' functions
are worked out in parallel, a scan over the splits of each file composes them, and then every task knows how its split
begins. Records that reach over a border leave a piece at either side; the pieces, two a split at most, are joined again.
"""

from __future__ import annotations

import csv
import itertools
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..arrow import map_arrow, on_workers
from .scratch import cut

#: A line that no file holds: where it becomes a record of its own, what came before was complete.
_END = "\x1e\x1eend of split\x1e\x1e"
_BREAKS = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)")
ROWS = 5000
SCAN = "file string, block long, after_outside boolean, after_inside boolean, opens boolean, valid boolean"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split of the file begins) and value (the bytes) of each line, in order within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _broken(line: str) -> list[str]:
    """A line with its break, and more lines if single carriage returns break it."""
    return [line + "\n"] if "\r" not in line[:-1] else _BREAKS.findall(line + "\n")


def _reader(lines: Iterator[str], delimiter: str):
    csv.field_size_limit(sys.maxsize)
    return csv.reader(lines, delimiter=delimiter)


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted value is open after a line that begins within quotes or outside."""
    rows = list(_reader(itertools.chain(['"\n'] if inside else [], _broken(line), [_END]), delimiter))
    return rows[-1] != [_END]


def _scan(delimiter: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list] = {}  # a task's splits
        for batch in batches:
            files, blocks, lines, valid = (batch.column(c) for c in ("file", "block", "quoted", "valid"))
            if not batch.num_rows:
                continue
            runs = [0, *(i for i in range(1, batch.num_rows) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1])] if files[0] != files[-1] or blocks[0] != blocks[-1] else [0]
            for a, b in zip(runs, [*runs[1:], batch.num_rows]):
                state = states.setdefault((files[a].as_py(), blocks[a].as_py()), [False, True, False, True])
                state[3] = state[3] and pc.all(valid.slice(a, b - a)).as_py()
                for raw in lines.slice(a, b - a).drop_null().to_pylist():
                    line = raw.decode("latin-1")  # quotes, breaks and delimiters are the same bytes
                    known = {s: ends_inside(line, s, delimiter) for s in {state[0], state[1]}}
                    state[2] = state[2] or (not state[0] and known[state[0]])
                    state[0], state[1] = known[state[0]], known[state[1]]
        rows = [(*key, *state) for key, state in states.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "block", "after_outside", "after_inside", "opens", "valid"])

    return run


def scan(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """A row for each split (SCAN): how it ends if it begins outside of quotes and within, whether a line of it ends within
    quotes if it begins outside, and whether its bytes are valid UTF-8. Only lines with quotes reach Python."""
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value").cast("binary"))
    lines = text_lines(spark, path).select("file", "block", quoted.alias("quoted"), F.is_valid_utf8("value").alias("valid"))
    return map_arrow(lines, _scan(delimiter), SCAN)


def _begin_inside(table: pa.Table) -> pa.Table:
    """The splits of a file that begin within quotes; one without a number stands for a file that ends so."""
    inside, found = False, []
    for row in table.sort_by("block").to_pylist():
        if inside:
            found.append(row)
        inside = row["after_inside"] if inside else row["after_outside"]
    if inside:
        found.append({"file": table.column("file")[0].as_py(), "block": None})
    return pa.table([pa.array([r["file"] for r in found], pa.string()), pa.array([r["block"] for r in found], pa.int64())], names=["file", "block"])


def _by_split(batches: Iterator[pa.RecordBatch], encoding: str) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    def lines() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                text = raw.decode(encoding, errors="replace")
                for line in _broken(text.removeprefix("﻿") if block == 0 else text):
                    yield (file, block), line

    for key, group in itertools.groupby(lines(), lambda x: x[0]):
        yield key, (line for _, line in group)


def _walk(lines: Iterator[str], inside: bool, delimiter: str) -> Iterator[tuple[str, list[str], list[str]]]:
    """(kind, fields, raw lines) of what a split holds: its records, and "head", "tail" or "middle" for a record's piece."""
    taken: list[str] = []

    def fed() -> Iterator[str]:
        if inside:
            yield '"\n'
        for line in lines:
            taken.append(line)
            yield line
        yield _END

    first = inside
    for fields in _reader(fed(), delimiter):
        if fields == [_END]:
            return
        if fields and fields[-1].endswith(_END):
            yield "middle" if first else "tail", fields, list(taken)
            return
        yield "head" if first else "record", fields, list(taken)
        first = False
        taken.clear()


def _columns(rows: list[list[str]], n: int) -> pa.RecordBatch:
    whole = [r[:n] if len(r) >= n else r + [None] * (n - len(r)) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*whole) if whole else [[]] * n)], names=[f"c{i}" for i in range(n)])


def _fits(fields: list[str], n: int) -> bool:
    """Neither a blank line nor more values than names."""
    return bool(fields) and (len(fields) > 1 or not fields[0] or bool(fields[0].strip())) and not any(fields[n:])


def _records(inside: set[tuple[str, int]], delimiter: str, encoding: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[str]] = []
        for key, lines in _by_split(batches, encoding):
            header = key[1] == 0
            for kind, fields, _ in _walk(lines, key in inside, delimiter):
                if kind == "record" and fields:
                    if not header and _fits(fields, n):
                        rows.append(fields)
                    header = False
                if len(rows) >= ROWS:
                    yield _columns(rows, n)
                    rows = []
        yield _columns(rows, n)

    return run


def _pieces(inside: set[tuple[str, int]], delimiter: str, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), lines in _by_split(batches, encoding):
            found = [(kind, "".join(raw)) for kind, _, raw in _walk(lines, (file, block) in inside, delimiter) if kind != "record"]
            columns = [[file] * len(found), [block] * len(found), [kind == "tail" for kind, _ in found], [raw for _, raw in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.string()))], names=["file", "block", "tail", "raw"])

    return run


def _joined(delimiter: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fields for raw in batch.column("raw").to_pylist() for fields in _reader(iter(_BREAKS.findall(raw if raw.endswith("\n") else raw + "\n")), delimiter)]
            yield _columns([r for r in rows if _fits(r, n)], n)

    return run


def read_records(spark: SparkSession, path: str, delimiter: str, encoding: str, n: int, scanned: DataFrame) -> DataFrame:
    """c0, c1, ... of every record after the first one of each file: ``n`` texts, null where a record is short.

    Records with more values than that, and blank lines, are left out; a quote that isn't closed takes all that is left of
    the file. ``scanned`` is the result of scan(). The splits
    that begin within quotes, a path and a number each, reach the driver and the tasks: one for each split at most.
    Records that reach over the border of two splits come last.
    """
    on_workers(spark)
    begins = scanned.groupBy("file").applyInArrow(_begin_inside, "file string, block long").collect()
    inside = {(r["file"], r["block"]) for r in begins}
    lines = text_lines(spark, path).withColumn("value", F.col("value").cast("binary"))
    schema = ", ".join(f"c{i} string" for i in range(n))
    whole = map_arrow(lines, _records(inside, delimiter, encoding, n), schema)
    if not inside:
        return whole
    pieces = map_arrow(lines, _pieces(inside, delimiter, encoding), "file string, block long, tail boolean, raw string")
    # A tail begins a record; the pieces that follow belong to it. Two rows a split at most.
    owner = F.sum(F.col("tail").cast("int")).over(Window.partitionBy("file").orderBy("block", "tail"))
    parts = pieces.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "raw"))).alias("parts"))
    return whole.unionByName(map_arrow(parts.select(F.array_join("parts.raw", "").alias("raw")), _joined(delimiter, n), schema))


def scan_once(spark: SparkSession, path: str, delimiter: str) -> tuple[DataFrame, bool, bool]:
    """scan() as a table, whether a quoted value holds a line break, and whether all is valid UTF-8."""
    scanned = cut(scan(spark, path, delimiter))
    row = scanned.agg(F.coalesce(F.bool_or("opens"), F.lit(False)), F.coalesce(F.bool_and("valid"), F.lit(True))).first()
    return scanned, row[0], row[1]
