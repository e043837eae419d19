"""Exact deduplication by counting quotient filters.

Each partition folds its fingerprints into counting quotient filters, one for each slice of the quotient space: runs of
remainders sorted within their quotient, each with a counter. Filters of one slice merge without loss, as sorted
remainders merge, and their counters add up. A fingerprint with a count of one has no partner. All others are routed to
verification, where the whole normalised texts are compared byte for byte by grouping on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import ascii_lower, cut, discard, free_name, map_arrow, table, texts_of

#: Leading bits of a fingerprint that choose the slice which one merge task handles.
SLICE_BITS = 10
#: Bits of the quotient below the slice bits; the rest of the 64 is the remainder.
QUOTIENT_BITS = 16
#: Fingerprints that a partition holds before it emits its filters and starts anew; bounds a worker's memory.
FILTER_CAPACITY = 1 << 20


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [hashlib.sha256(t.lower()).digest() for t in texts_of(batch)]  # bytes.lower() maps A-Z only
        prints = np.frombuffer(b"".join(d[:8] for d in digests), dtype=">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints), pa.array([d.hex() for d in digests], pa.string())],
            names=["doc_id", "fp", "text_sha256"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, 64-bit fingerprint and SHA-256 of each normalised text (null: empty; A-Z lower-cased)."""
    return map_arrow(docs.select("doc_id", "text"), _fingerprints, "doc_id long, fp long, text_sha256 string")


def encode_filter(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """A filter of sorted distinct fingerprints of one slice: occupied quotients, their run lengths, remainders, counters."""
    rest = 64 - SLICE_BITS - QUOTIENT_BITS
    quotients = (prints >> np.uint64(rest)) & np.uint64((1 << QUOTIENT_BITS) - 1)
    remainders = prints & np.uint64((1 << rest) - 1)
    occupied, runs = np.unique(quotients, return_counts=True)
    head = np.array([len(occupied), len(prints)], dtype="<u4")
    return b"".join(
        (head.tobytes(), occupied.astype("<u2").tobytes(), runs.astype("<u4").tobytes(), remainders.astype("<u8").tobytes(), counts.astype("<u4").tobytes())
    )


def decode_filter(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quotients, remainders and counters, in order of quotient and remainder."""
    n_occupied, n = np.frombuffer(blob, "<u4", 2)
    at = 8
    occupied = np.frombuffer(blob, "<u2", n_occupied, at)
    at += 2 * int(n_occupied)
    runs = np.frombuffer(blob, "<u4", n_occupied, at)
    at += 4 * int(n_occupied)
    remainders = np.frombuffer(blob, "<u8", n, at)
    return np.repeat(occupied, runs).astype(np.uint64), remainders, np.frombuffer(blob, "<u4", n, at + 8 * int(n)).astype(np.int64)


def merge_filters(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slice-local fingerprints (quotient and remainder joined) and the sums of their counters."""
    rest = 64 - SLICE_BITS - QUOTIENT_BITS
    keys, counts = [], []
    for blob in blobs:
        q, r, c = decode_filter(blob)
        keys.append((q << np.uint64(rest)) | r)
        counts.append(c)
    merged, where = np.unique(np.concatenate(keys), return_inverse=True)
    return merged, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        prints, counts = np.unique(np.concatenate(held), return_counts=True)
        slices = prints >> np.uint64(64 - SLICE_BITS)
        edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1], True])
        blobs = [encode_filter(prints[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(slices[edges[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["slice", "filter"]
        )
        held.clear()

    for batch in batches:
        if batch.num_rows:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
        if sum(map(len, held)) >= FILTER_CAPACITY:
            yield from flush()
    if held:
        yield from flush()


def _merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    local, counts = merge_filters(list(group["filter"]))
    many = counts > 1
    prints = (np.uint64(key[0]) << np.uint64(64 - SLICE_BITS)) | local[many]
    return pd.DataFrame({"fp": prints.view(np.int64), "n": counts[many]})


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """fp and its count, for every fingerprint counted more than once, from the merged filters."""
    built = map_arrow(prints.select("fp"), _build, "slice int, filter binary")
    return built.groupBy("slice").applyInPandas(_merge, "fp long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, route.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and all empty texts are equal. Of
    equal texts the largest doc_id stays (null ids count as smaller than all others). Rows repeated with the same doc_id
    are counted one by one and marked alike. Long texts are hashed and compared whole. ``route`` is ``verify`` where the filters counted the fingerprint more than
    once and the bytes were compared, else ``unique``. Further columns of ``docs`` are not read. An empty input gives an
    empty result.
    """
    rows = docs.select("doc_id", "text")
    prints = cut(fingerprints(rows))
    repeated = repeated_fingerprints(prints).select("fp", F.lit(True).alias("_many"))
    routed = cut(prints.join(repeated, "fp", "left").select("doc_id", "text_sha256", F.coalesce("_many", F.lit(False)).alias("_many")))
    discard(prints)
    suspects = routed.where("_many").select(F.col("doc_id").alias("_id")).distinct()
    # The suspects are the small side, so their rows are hashed and the texts stream past without a sort.
    whole = rows.join(suspects.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    groups = (
        whole.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("_text"))
        .groupBy("_text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    return routed.join(groups, routed.text_sha256 == groups["_sha"], "left").select(
        "doc_id",
        F.when(F.col("_many"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.when(F.col("_many"), F.col("keep_id")).otherwise(F.col("doc_id"))), F.lit(True)).alias("kept"),
        "text_sha256",
        F.when(F.col("_many"), "verify").otherwise("unique").alias("route"),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated in doc_id and text one stays.

    Rows are decided by doc_id and normalised text together, so neither null nor repeated ids stand for each other's texts.
    Columns of any name pass through. An empty table gives an empty result.
    """
    key, digest, n = (free_name(docs, x) for x in ("_keep_id", "_keep_sha", "_n"))
    kept = exact_groups(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias(n))
    kept = cut(kept.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest), n))
    sha = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    rows = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(key)) & (sha == F.col(digest)))
    once = rows.where(F.col(n) == 1).select(*(docs[f"`{x}`"] for x in docs.columns))
    # Only if an id repeats with its text do the rows have to meet again.
    if kept.where(F.col(n) > 1).isEmpty():
        return once
    repeated = rows.where(F.col(n) > 1).dropDuplicates([key, digest])
    return once.unionByName(repeated.select(*(docs[f"`{x}`"] for x in docs.columns)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("route")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
