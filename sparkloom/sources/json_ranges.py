"""JSON files that hold one large array, bare or in an object, read by many tasks.

A file is read in pieces that end at its closing braces, in the splits that Spark makes; so an array on one line is split,
too. Whether a piece begins within a string, and how deep, depends on all before it, but each split is a function from
(outside, inside a string) to the same and a change of depth. The functions are worked out in parallel, a scan over the
splits of each file composes them, and then every task finds the objects of its splits. Objects that reach over a border
leave a piece at either side; those are joined again. The result is a table of JSON lines in the shared folder.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..arrow import map_arrow, on_workers
from .scratch import cut, shared_path

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{\[\]:,]', re.S)
_SPACE = str.maketrans("\r\n\t", "   ")

#: Where a split begins: within a string, how deep, and under which key of the object (None if under no array of one).
Start = tuple[bool, int, str | None]


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split of the file begins) and value: the text up to each closing brace, without the brace."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def bare(text: str, inside: bool) -> tuple[str, bool]:
    """What of a piece stands outside of strings, and whether it ends within one."""
    if inside:
        end = _STRING_END.match(text)
        if end is None:
            return "", True
        text = text[end.end() :]
    if '"' in text:
        text = _STRING.sub("", text)
        at = text.find('"')
        if at >= 0:
            return text[:at], True
    return text, False


def deeper(text: str, inside: bool) -> tuple[bool, int]:
    """How a piece and its brace end that begins within a string or outside: within one, and by how much deeper."""
    text, inside = bare(text, inside)
    return inside, text.count("{") + text.count("[") - text.count("]") - (not inside)


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    def pieces() -> Iterator[tuple[tuple[str, int], str]]:
        for batch in batches:
            for file, block, raw in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                text = raw.decode("utf-8", errors="replace")
                yield (file, block), text.removeprefix("﻿") if block == 0 else text

    for key, group in itertools.groupby(pieces(), lambda x: x[0]):
        yield key, (text for _, text in group)


SCAN = "file string, block long, outside_after boolean, outside_depth long, inside_after boolean, inside_depth long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (file, block), pieces in _by_split(batches):
        after, depth = [False, True], [0, 0]
        for text in pieces:
            known = {s: deeper(text, s) for s in set(after)}
            for i in (0, 1):
                depth[i] += known[after[i]][1]
                after[i] = known[after[i]][0]
        row = {"file": file, "block": block, "outside_after": after[0], "outside_depth": depth[0], "inside_after": after[1], "inside_depth": depth[1]}
        yield pa.RecordBatch.from_pylist([row])


def _starts(table: pa.Table) -> pa.Table:
    inside, depth, found = False, 0, []
    for row in table.sort_by("block").to_pylist():
        found.append({"file": row["file"], "block": row["block"], "inside": inside, "depth": depth})
        side = "inside" if inside else "outside"
        inside, depth = row[f"{side}_after"], depth + row[f"{side}_depth"]
    return pa.Table.from_pylist(found)


def walk(pieces: Iterator[str], start: Start, base: int) -> Iterator[tuple[str, str | None, str]]:
    """(kind, key, text) of what a split holds: "record" for an object at depth ``base``, "head", "tail" or "middle" for an
    object's piece, "key" for the key of an array that begins (base 2) and for the end of one (None)."""
    inside, depth, key = start
    held, whole = ([], False) if depth > base and (base == 1 or key is not None) else (None, True)
    for text in pieces:
        after, change = deeper(text, inside)
        if held is None:
            at = _begin(text, inside, depth, base, key)
            for name in at[1]:
                yield "key", name, ""
                key = name
            if at[0] >= 0:
                held, whole = [text[at[0] :]], True
        else:
            held.append(text)
        inside, depth = after, depth + change
        if held is not None and depth == base and not inside:
            yield "record" if whole else "head", key, "}".join([*held, ""])
            held = None
        if base == 2 and depth < 2 and key is not None and not inside:
            yield "key", None, ""
            key = None
    if held is not None:
        yield "tail" if whole else "middle", key, "}".join([*held, ""])


def _begin(text: str, inside: bool, depth: int, base: int, key: str | None) -> tuple[int, list[str | None]]:
    """Where in a piece an object begins at depth ``base`` (-1: nowhere), and the keys whose arrays begin or end before."""
    at, last, named, keys = 0, None, None, []
    if inside:
        end = _STRING_END.match(text)
        if end is None:
            return -1, keys
        at = end.end()
    for token in _TOKEN.finditer(text, at):
        what = token.group()
        if what == '"':
            break
        if what[0] == '"':
            last = what
        elif what == ":":
            named = last if depth == 1 else named
        elif what == ",":
            named = None if depth == 1 else named
        elif what == "]":
            depth -= 1
            if base == 2 and depth == 1 and key is not None:
                key = None
                keys.append(None)
        else:
            if what == "{" and depth == base and (base == 1 or key is not None):
                return token.start(), keys
            if what == "[" and depth == 1 and base == 2 and named is not None:
                key = json.loads(named)
                keys.append(key)
            depth += 1
    return -1, keys


def _events(starts: dict[tuple[str, int], Start]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, pieces in _by_split(batches):
            keys = [key for kind, key, _ in walk(pieces, starts[at], 2) if kind == "key"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[0]] * len(keys), pa.string()), pa.array([at[1]] * len(keys), pa.int64()), pa.array(range(len(keys)), pa.int64()), pa.array(keys, pa.string())],
                names=["file", "block", "n", "key"],
            )

    return run


def _find(starts: dict[tuple[str, int], Start], base: int, wanted: str | None, kinds: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(types)], names=["file", "block", "tail", "value"])

        for at, pieces in _by_split(batches):
            for kind, key, text in walk(pieces, starts[at], base):
                if kind in kinds and (base == 1 or key == wanted):
                    # Breaks stand between values only.
                    rows.append((*at, kind == "tail", text.translate(_SPACE)))
                    if len(rows) >= 5000:
                        yield batch()
                        rows.clear()
        yield batch()

    return run


def to_lines(spark: SparkSession, path: str, wrappers: tuple[str, ...] | None = None) -> str | None:
    """The path of JSON lines in the shared folder with the objects of the array that each file holds.

    With ``wrappers`` the files hold an object, and the array is under the first of these keys that any of them has; None
    if there is none. Elements that are no objects are left out. A row for each split, with where it begins, reaches the
    driver and the tasks; so do the keys of the outer object that hold arrays.
    """
    pieces, base = pieces_of(spark, path), 2 if wrappers else 1
    on_workers(spark)
    scanned = cut(map_arrow(pieces, _scan, SCAN))
    states = scanned.groupBy("file").applyInArrow(_starts, "file string, block long, inside boolean, depth long").collect()
    starts: dict[tuple[str, int], Start] = {(r["file"], r["block"]): (r["inside"], r["depth"], None) for r in states}
    wanted = None
    if wrappers:
        # An array that began before a split isn't known yet: what is in it counts once its key is.
        events = map_arrow(pieces, _events(starts), "file string, block long, n long, key string").collect()
        found = {r["key"] for r in events}
        wanted = next((w for w in wrappers if w in found), None)
        if wanted is None:
            return None
        last = {}
        for r in sorted(events, key=lambda r: (r["file"], r["block"], r["n"])):
            last[r["file"], r["block"]] = r["key"]
        key, before = None, None
        for at in sorted(starts):
            key = None if before != at[0] else key
            starts[at] = (*starts[at][:2], key if starts[at][1] >= 2 else None)
            key, before = last.get(at, key), at[0]
    schema = "file string, block long, tail boolean, value string"
    out = shared_path(spark, "lines")
    map_arrow(pieces, _find(starts, base, wanted, ("record",)), schema).select("value").write.text(out)
    # A tail begins an object; the pieces that follow belong to it. Two rows a split at most.
    parts = map_arrow(pieces, _find(starts, base, wanted, ("head", "middle", "tail")), schema)
    owner = F.sum(F.col("tail").cast("int")).over(Window.partitionBy("file").orderBy("block", "tail"))
    joined = parts.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"))
    if len(starts) > 1:
        joined.select(F.array_join("parts.value", "").alias("value")).write.mode("append").text(out)
    return out
