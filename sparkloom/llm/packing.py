"""Best-fit packing of documents into sequences of bounded length, by large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of lengths: at most ``capacity``
counts, whatever the corpus holds. Documents above one third of the capacity fit at most twice into a sequence; from the
longest down each is matched with the longest partner that fits, many equal pairs at a time. Smaller documents, from the
longest down, go into the tightest remaining gap, and open new sequences when none is left. The plan is a list of groups
of sequences filled alike. Spark then numbers the documents of each length and looks up which place has that number.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .common import cut, map_arrow, table
from .tokens import default_ranks, id_bytes

CAPACITY = 2048
SEPARATOR_ID = 0
#: Rows of one length that one task numbers, about.
ROWS_PER_SALT = 100_000


def plan_groups(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths in a sequence, how many such sequences) that hold every item of the histogram once."""
    left = Counter({size: n for size, n in histogram.items() if n > 0})
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    open_groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(pattern)
        if gap:
            open_groups.setdefault(gap, []).append((pattern, n))
        else:
            done.append((pattern, n))

    ascending = large[::-1]
    for size in large:
        at = bisect.bisect_right(ascending, min(size, capacity - size)) - 1
        while left[size] and at >= 0:
            partner = ascending[at]
            n = left[size] // 2 if partner == size else min(left[size], left[partner])
            if n:
                left[size] -= n
                left[partner] -= n
                put((size, partner), n)
            at -= 1
        if left[size]:
            put((size,), left[size])
            left[size] = 0
    gaps = sorted(open_groups)
    for size in sorted((s for s in left if left[s]), reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                groups, gap = [((), -(-n // each))], capacity
            else:
                gap = gaps.pop(at)
                groups = open_groups.pop(gap)
            each = gap // size
            for pattern, count in groups:
                full = min(count, n // each)
                over = n - full * each if full < count else 0
                parts = [(pattern + (size,) * each, full)]
                if over:
                    parts.append((pattern + (size,) * over, 1))
                if rest := count - full - bool(over):
                    parts.append((pattern, rest))
                n -= full * each + over
                for filled, m in parts:
                    if m and filled:
                        new = capacity - sum(filled)
                        if new and new not in open_groups:
                            bisect.insort(gaps, new)
                        put(filled, m)
    for groups in open_groups.values():
        done.extend(groups)
    return done


def place_rows(groups: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first number, count, first sequence, offset): the items of that length with these numbers go there."""
    taken: Counter = Counter()
    sequence, rows = 0, []
    for pattern, n in groups:
        offset = 0
        for size in pattern:
            rows.append((size, taken[size], n, sequence, offset))
            taken[size] += n
            offset += size
        sequence += n
    return rows


def cut_lengths(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first if the length isn't a multiple."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def _pieces(ranks_path: str, capacity: int, separator: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = id_bytes(text or "", ranks_path) + separator
                    for k, (start, length) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                        for column, value in zip(columns, (doc_id, k, start, length, ids[4 * start : 4 * (start + length)])):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return run


def token_pieces(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length and ids (little-endian unsigned 32-bit).

    A document is its text's ids and a separator; a null or empty text is the separator alone. Only documents longer than
    the capacity are cut, and then only the first piece may be shorter than it. Further columns are not read.
    """
    run = _pieces(ranks_path or default_ranks(), capacity, SEPARATOR_ID.to_bytes(4, "little"))
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids binary")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to items (doc_id, piece, length of 1 to capacity, and further columns).

    Items of a sequence lie without gaps from 0 and take at most ``capacity``. Every row is placed, repeated rows one by
    one; which of several items of equal length goes where follows doc_id and piece (nulls first). Further columns
    pass through, but for such named sequence_id or offset, which are replaced. Empty input, empty result. The items are
    written to the shared folder once.
    """
    spark = items.sparkSession
    items = cut(items)
    kept = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    # At most ``capacity`` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(
        place_rows(plan_groups(histogram, capacity)) or [(0, 0, 0, 0, 0)],
        "size long, first long, n long, sequence long, offset long",
    )
    # Items of one length are numbered in salted parts, each from the count of the parts before it.
    salts = max(64, max(histogram.values(), default=0) // ROWS_PER_SALT)
    salted = items.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("length").cast("long").alias("size"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt")
    )
    before = (
        salted.groupBy("size", "salt")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    )
    within = Window.partitionBy("size", "salt").orderBy("row.doc_id", "row.piece")
    numbered = salted.withColumn("own", F.row_number().over(within)).join(before, ["size", "salt"])
    numbered = numbered.select("row", "size", (F.col("before") + F.col("own") - 1).alias("number"))
    # Each length's places, in the order of their first numbers. The plan has a bounded number of rows (see place_rows).
    by_length = places.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "offset"))).alias("places"))
    placed = numbered.join(F.broadcast(by_length), "size")
    at = F.filter("places", lambda p: (p["first"] <= F.col("number")) & (F.col("number") < p["first"] + p["n"]))[0]
    return placed.withColumn("at", at).select(
        *(F.col("row")[c].alias(c) for c in kept), (F.col("at.sequence") + F.col("number") - F.col("at.first")).alias("sequence_id"), F.col("at.offset").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and the joined ids of each packed sequence; ``packed`` carries the pieces' ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("_parts")).select(
        "sequence_id",
        F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("_parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"),
    )


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the CRC-32 of their ids and their places.

    A null or empty text is one separator, a text of any length is packed whole, in pieces; repeated rows and null ids are
    documents of their own. Further columns aren't read. An empty table gives an empty result.
    """
    pieces = token_pieces(docs, ranks_path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
