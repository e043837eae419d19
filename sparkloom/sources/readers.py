"""Readers: formats by name and content, CSV with uneven rows, JSON in several shapes, Parquet, Excel if available."""

from __future__ import annotations

import csv
import io
import os
import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.casts import free_name, na_to_null
from . import json_ranges, quoted
from .scratch import cut, shared_path

# Formats by extension, delimiters and the keys that wrap an array of records.
EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "excel", "xls": "excel", "xlsm": "excel", "json": "json", "jsonl": "json", "parquet": "parquet", "pq": "parquet"}
DELIMITERS = (",", ";", "\t", "|", ":")
WRAPPERS = ("data", "records", "items", "results", "rows")
OVERFLOW = "_overflow"
HEAD_BYTES = 65_536


def detect_format(name: str | None = None, head: bytes | None = None) -> str:
    """By the extension, else by the first bytes; csv if neither tells."""
    known = EXTENSIONS.get(os.path.splitext(name or "")[1].lstrip(".").lower())
    if known:
        return known
    start = (head or b"")[:500].lstrip()
    if start.startswith(b"PAR1"):
        return "parquet"
    return "json" if start[:1] in (b"{", b"[") else "csv"


def _steady_delimiter(text: str) -> str:
    """What csv.Sniffer finds in a text without quotes, or nothing.

    The sniffer counts 127 letters in each line, each by itself, and looks at the delimiters asked for last; here only those
    are counted. A letter's mode is its most frequent count, less the lines with others, over ten lines and then ten more.
    """
    lines = [x for x in text.split("\n") if x]
    times: dict[str, dict[int, int]] = {d: {} for d in DELIMITERS}
    modes: dict[str, tuple[int, int]] = {}
    found: dict[str, tuple[int, int]] = {}
    for begin in range(0, len(lines), 10):
        for d, of in times.items():
            for line in lines[begin : begin + 10]:
                n = line.count(d)
                of[n] = of.get(n, 0) + 1
            if of.keys() != {0}:
                n, k = max(of.items(), key=lambda x: x[1])
                modes[d] = (n, 2 * k - sum(of.values()))
        total = float(min(begin + 10, len(lines)))
        share = 1.0
        while not found and share >= 0.9:
            found = {d: m for d, m in modes.items() if m[0] > 0 and m[1] > 0 and m[1] / total >= share}
            share -= 0.01
        if len(found) == 1:
            return next(iter(found))
    for d in csv.Sniffer().preferred if len(found) > 1 else ():
        if d in found:
            return d
    return max(((m, d) for d, m in found.items()), default=(None, ""))[1]


def sniff_delimiter(text: str) -> str:
    """As csv.Sniffer tells; where it doesn't, the most frequent one."""
    head = text[:4096]
    try:
        found = csv.Sniffer().sniff(head, "".join(DELIMITERS)).delimiter if "'" in head or '"' in head else _steady_delimiter(head)
    except csv.Error:
        found = ""
    if found:
        return found
    counts = {d: text[:2000].count(d) for d in DELIMITERS[:4]}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else ","


def head_of(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file (of the first one of a folder), read through Spark, so that any of its stores will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    matched = fs.globStatus(root)
    status = matched[0] if matched else fs.getFileStatus(root)
    if status.isDirectory():
        files = sorted((f.getPath().toString() for f in fs.listStatus(status.getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"))
        status = fs.getFileStatus(hadoop.Path(files[0]))
    stream = fs.open(status.getPath())
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all of the bytes are valid in it, else ISO-8859-1; line breaks are the same bytes in both."""
    return "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def _text(head: bytes, encoding: str) -> str:
    return head.decode(encoding, errors="replace").lstrip("\ufeff")


def first_line_of(spark: SparkSession, path: str) -> bytes:
    """The head of a file, with as much more as its first line needs."""
    n = HEAD_BYTES
    while True:
        head = head_of(spark, path, n)
        if b"\n" in head or len(head) < n:
            return head
        n *= 8


#: Encodings in which the bytes of quotes, line breaks and delimiters stand for nothing else, so that lines can be split.
_SPLIT_BY_LINES = re.compile(r"(?i)utf-?8|us-?ascii|iso-?8859-?\d+|latin-?\d|windows-?125\d|cp125\d")


def csv_layout(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> tuple[str, str, str]:
    """Delimiter, encoding and the head of a CSV file; the encoding is decided on all bytes, the delimiter on the head."""
    head = first_line_of(spark, path)
    encoding = encoding or detect_encoding(spark, path)
    text = _text(head, encoding)
    return delimiter or sniff_delimiter(text), encoding, text


def first_rows(df: DataFrame, nrows: int | None) -> DataFrame:
    """As many rows at most, for previews; all without a number."""
    return df if nrows is None else df.limit(nrows)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multiline: bool | None = None, nrows: int | None = None) -> DataFrame:
    """All columns as text, NA values as null. Short rows are filled with nulls; rows with more values than names are left out.

    Quoted values may hold line breaks and doubled quotes; a quote within a value that doesn't begin with one is a letter.
    A pass over the lines that hold quotes tells whether there are such breaks, and in the same pass whether the bytes are
    UTF-8 (else they are ISO-8859-1). Files without them go to Spark's own reader, others are read by quoted.read_records;
    both split large files among tasks. ``multiline=True`` has Spark read each file whole in one task, which encodings of
    several bytes a letter need, and ``multiline=False`` takes each line for a row without looking.
    """
    head = first_line_of(spark, path)
    by_lines = encoding is None or _SPLIT_BY_LINES.fullmatch(encoding) is not None
    delimiter = delimiter or sniff_delimiter(_text(head, encoding or "UTF-8"))
    scanned, breaks = None, False
    if multiline is None and by_lines:
        scanned, breaks, valid = quoted.scan_once(spark, path, delimiter)
        encoding = encoding or ("UTF-8" if valid else "ISO-8859-1")
    encoding = encoding or detect_encoding(spark, path)
    header = next(csv.reader(io.StringIO(_text(head, encoding), newline=""), delimiter=delimiter), [])
    names = [h.strip() or f"_c{i}" for i, h in enumerate(header)]
    seen: dict[str, int] = {}
    for i, h in enumerate(names):
        seen[h] = seen.get(h, 0) + 1
        names[i] = h if seen[h] == 1 else f"{h}.{seen[h] - 1}"
    if breaks and scanned is not None and names:
        rows = quoted.read_records(spark, path, delimiter, encoding, len(names), scanned).toDF(*names)
    else:
        schema = StructType([StructField(h, StringType()) for h in [*names, OVERFLOW]])
        rows = (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", delimiter).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline or not by_lines).option("mode", "PERMISSIVE").csv(path)
        ).where(F.col(OVERFLOW).isNull())
    return first_rows(rows.select(*(na_to_null(F.col(f"`{c}`")).alias(c) for c in names)), nrows)


def flatten(df: DataFrame) -> DataFrame:
    """Structs as columns with dotted names, however deep; arrays stay."""

    def leaves(kind: StructType, path: tuple[str, ...]) -> list:
        out = []
        for f in kind.fields:
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                out.extend(leaves(f.dataType, at))
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(".".join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """Whether there are several lines and the first one, or more than half of them, are objects on their own.

    Of the lines of one object or array that is laid out over several, the first isn't, nor are two that follow each other.
    """
    line = F.trim(F.regexp_replace("value", r"^\uFEFF|[\r\t]", " "))
    own = F.coalesce(line.startswith("{") & line.endswith("}") & F.json_object_keys(line).isNotNull(), F.lit(False))
    lines = spark.read.text(path).where(line != "").select(own.alias("own"))
    n, whole = lines.agg(F.count(F.lit(1)), F.count_if("own")).first()
    return n > 1 and whole > 0 and (2 * whole > n or lines.first().own)


def json_layout(spark: SparkSession, path: str) -> str:
    array = head_of(spark, path).decode("utf-8", errors="replace").lstrip("\ufeff \t\r\n").startswith("[")
    return "jsonl" if not array and is_json_lines(spark, path) else "json"


def read_json(spark: SparkSession, path: str, flat: bool = True, nrows: int | None = None) -> DataFrame:
    """JSON lines (malformed lines left out), an array of objects, one object, or an object that wraps an array of records.

    An array, bare or under one of the wrapping keys, is found in ranges of the file and written as JSON lines to the
    shared folder first, so a large one is read by many tasks, on however few lines it stands. An empty array has no rows;
    elements that are no objects are left out. Any other object is one row.
    """
    start = head_of(spark, path).decode("utf-8", errors="replace").lstrip("\ufeff \t\r\n")[:1]
    by_line = start != "[" and is_json_lines(spark, path)
    lines = None if by_line else json_ranges.to_lines(spark, path, None if start == "[" else WRAPPERS)
    df = spark.read.option("multiLine", not by_line and lines is None).option("mode", "DROPMALFORMED").json(lines or path)
    return first_rows(flatten(df) if flat else df, nrows)


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    return first_rows(spark.read.parquet(path), nrows)


def sheets_of(path: str) -> list[str]:
    """The names of a workbook's sheets; needs openpyxl."""
    import openpyxl

    return openpyxl.load_workbook(path, read_only=True).sheetnames


def read_excel(spark: SparkSession, path: str, sheet: int | str = 0, nrows: int | None = None) -> DataFrame:
    """One sheet of a workbook, which fits the driver by its format's limits; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise RuntimeError("reading Excel needs the package openpyxl") from e
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, nrows=nrows))


def format_of(spark: SparkSession, path: str, hint: str | None = None) -> str:
    """The hint, else what the name and the first bytes say."""
    by_name = EXTENSIONS.get(os.path.splitext(path)[1].lstrip(".").lower())
    kind = (hint or detect_format(path, None if by_name else head_of(spark, path, 500))).lower()
    return EXTENSIONS.get(kind, kind if kind in ("csv", "excel") else "csv")


def extract(spark: SparkSession, path: str, hint: str | None = None, **options) -> DataFrame:
    """Reads by the hint, else by the name and the first bytes; column names are stripped."""
    read = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "excel": read_excel}[format_of(spark, path, hint)]
    df = read(spark, path, **options)
    return df.toDF(*(c.strip() for c in df.columns))


def extract_with_meta(spark: SparkSession, path: str, hint: str | None = None, **options) -> tuple[DataFrame, dict]:
    """The rows and what is known of their source: format, row_count and col_count, for CSV delimiter and encoding, for JSON
    whether it was flattened, for Excel the sheets. The rows are counted by a pass of their own."""
    kind = format_of(spark, path, hint)
    meta: dict = {"format": kind}
    if kind == "csv":
        meta["delimiter"], meta["encoding"], _ = csv_layout(spark, path, options.get("delimiter"), options.get("encoding"))
        options |= {"delimiter": meta["delimiter"], "encoding": meta["encoding"]}
    elif kind == "json":
        meta |= {"format": json_layout(spark, path), "flattened": options.get("flat", True)}
    elif kind == "excel":
        meta |= {"sheet_names": sheets_of(path), "selected_sheet": str(options.get("sheet", 0))}
    df = extract(spark, path, kind, **options)
    return df, meta | {"row_count": df.count(), "col_count": len(df.columns)}


def stored(spark: SparkSession, content: bytes | str, name: str = "input") -> str:
    """The path of a file in the shared folder with the content of a source that is in memory, for any reader."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_path(spark, 'source')}/{os.path.basename(name)}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(content.encode() if isinstance(content, str) else bytes(content))
    finally:
        stream.close()
    return path.toString()


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """Dense row numbers from 0 in the order of partitions: counts by partition first, then numbers within.

    The rows are written to the shared folder once, so that a partition keeps its number whatever is computed again.
    """
    part, at = free_name(df, "_part"), free_name(df, "_at")
    tagged = cut(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    counts = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col(part).alias("_p"), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("_start"))
    # A row for each partition. The low 33 bits of the identifier count the rows of its partition.
    joined = tagged.join(F.broadcast(starts), F.col(part) == F.col("_p"))
    return joined.select(*(tagged[f"`{c}`"] for c in df.columns), (F.col("_start") + F.col(at).bitwiseAND((1 << 33) - 1)).cast("long").alias(name))
