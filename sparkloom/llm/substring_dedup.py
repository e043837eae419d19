"""Removal of passages that documents with smaller ids already hold.

Every window of WINDOW consecutive words gets a Rabin-Karp hash: a polynomial over the words' 64-bit hashes, taken mod
2^64 and mixed. Each task folds its documents' windows (the smallest document of each hash stands for the others there)
and sends them, grouped by the hash's leading bits, to counting tasks that find each hash's smallest document over the
corpus. Starts of repeated windows come back, merge into maximal intervals of words, and those words are removed.

Within a bucket a hash is stored without the bits that the bucket gives, so nothing of the 64 bits is lost. For N windows
about N^2 / 2^65 pairs of different windows are taken for equal: 0.0005 for a hundred million windows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table, texts_of

#: Words of a window.
WINDOW = 13
#: Base of the polynomial; odd, so that it is invertible mod 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows that a task holds before it sends them on; bounds a worker's memory.
HELD_WINDOWS = 1_000_000
#: Documents whose words are removed at a time.
BLOCK = 500
#: Distinct words whose hashes a worker remembers.
HELD_WORDS = 300_000


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to HELD_WORDS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def window_hashes(words: list[bytes], cache: WordHashes, window: int = WINDOW) -> np.ndarray:
    """The hash of each run of ``window`` words, by Horner's rule over all starts at once."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h *= BASE
        h += each[k : k + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def _send(bucket_bits: int, window: int):
    """Rows of (bucket, filter blob) to count and (doc_id, starts) already known to repeat in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, hashes, ids = WordHashes(), [], []

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(hashes)
            lengths = np.array([len(x) for x in hashes])
            doc = np.repeat(np.array(ids, np.int64), lengths)
            hashes.clear()
            ids.clear()
            start = (np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            order = np.argsort(h, kind="stable")
            edges = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
            smallest = np.minimum.reduceat(doc[order], edges)
            first = np.empty(len(h), bool)
            first[order] = doc[order] == np.repeat(smallest, np.diff(np.r_[edges, len(h)]))
            repeated = np.flatnonzero(~first)
            # One row a bucket: the hashes' lower bytes, the documents and the starts, in text order.
            keep = np.flatnonzero(first)
            bucket = (h[keep] >> np.uint64(64 - bucket_bits)).astype(np.int32)
            by_bucket = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by_bucket]) != 0, True])
            low = 8 - bucket_bits // 8
            blobs = {"bucket": [], "hashes": [], "docs": [], "counts": [], "starts": []}
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = keep[by_bucket[a:b]]
                own, at = np.unique(doc[part], return_index=True) if np.all(np.diff(doc[part]) >= 0) else (None, None)
                if own is None:
                    part = part[np.argsort(doc[part], kind="stable")]
                    own, at = np.unique(doc[part], return_index=True)
                blobs["bucket"].append(int(bucket[by_bucket[a]]))
                blobs["hashes"].append(h[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low].tobytes())
                blobs["docs"].append(pack_ints(np.diff(own, prepend=0)))
                blobs["counts"].append(pack_ints(np.diff(np.r_[at, len(part)])))
                blobs["starts"].append(pack_starts(start[part], at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs["bucket"], pa.int32()), *(pa.array(blobs[c], pa.binary()) for c in ("hashes", "docs", "counts", "starts")), pa.nulls(len(blobs["bucket"]), pa.int64()), pa.nulls(len(blobs["bucket"]), pa.list_(pa.int32()))],
                names=NAMES,
            )
            if len(repeated):
                # These need no counting; they pass through some bucket's task on their way to the join.
                own, starts = starts_by_doc(doc[repeated], start[repeated])
                empty = pa.nulls(len(own), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own % (1 << bucket_bits), pa.int32()), empty, empty, empty, empty, pa.array(own, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], names=NAMES
                )

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                h = window_hashes(text.split(), cache, window)  # bytes.split() parts at \x20 and \x09-\x0D only
                if doc_id is None or not len(h):
                    continue
                hashes.append(h)
                ids.append(doc_id)
                held += len(h)
                if held >= HELD_WINDOWS:
                    yield from flush()
                    held = 0
        if held:
            yield from flush()

    return run


NAMES = ["bucket", "hashes", "docs", "counts", "starts", "doc_id", "repeated"]
SENT = "bucket int, hashes binary, docs binary, counts binary, starts binary, doc_id long, repeated array<int>"


def pack_ints(values: np.ndarray) -> bytes:
    """Integers by byte planes, lowest first: the planes of small numbers are all but zero, and the shuffle compresses them."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ints(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def pack_starts(starts: np.ndarray, at: np.ndarray) -> bytes:
    """Starts as gaps within each document."""
    gaps = np.diff(starts.astype(np.int64), prepend=0)
    gaps[at] = starts[at]
    return pack_ints(gaps)


def unpack_starts(blob: bytes, counts: np.ndarray) -> np.ndarray:
    gaps = unpack_ints(blob)
    total = np.cumsum(gaps)
    at = np.cumsum(counts) - counts
    return total - np.repeat(total[at] - gaps[at], counts)


def starts_by_doc(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(doc):
        return doc, []
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype(np.int32)
    own, at = np.unique(doc, return_index=True)
    return own, np.split(start, at[1:])


def _count(low: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket, the starts of windows that a smaller document holds too."""
        known = group.loc[group["hashes"].isna(), ["doc_id", "repeated"]]
        group = group[group["hashes"].notna()]
        if group.empty:
            return known
        keys, docs, starts = [], [], []
        for blob, ids, counts, gaps in zip(group["hashes"], group["docs"], group["counts"], group["starts"]):
            n = len(blob) // low
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :low] = np.frombuffer(blob, np.uint8).reshape(n, low)
            counts = unpack_ints(counts)
            keys.append(wide.view("<u8").ravel())
            docs.append(np.repeat(np.cumsum(unpack_ints(ids)), counts))
            starts.append(unpack_starts(gaps, counts))
        h, doc, start = np.concatenate(keys), np.concatenate(docs), np.concatenate(starts)
        order = np.argsort(h, kind="stable")
        edges = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]])
        smallest = np.minimum.reduceat(doc[order], edges)
        repeated = order[doc[order] > np.repeat(smallest, np.diff(np.r_[edges, len(h)]))]
        own, lists = starts_by_doc(doc[repeated], start[repeated])
        return pd.concat([pd.DataFrame({"doc_id": own, "repeated": lists}), known]) if len(own) else known

    return run


def merge_intervals(starts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) of the words that windows at these starts cover."""
    s = np.unique(starts)
    if not len(s):
        return []
    breaks = np.flatnonzero(np.diff(s) > window)
    return list(zip(s[np.r_[0, breaks + 1]].tolist(), (s[np.r_[breaks, len(s) - 1]] + window).tolist()))


def bucket_bits_for(n_bytes: int) -> int:
    """Leading bits of the hash that name the bucket: from 256 buckets on, one for each 8 MB of text or so."""
    return min(max(8, (n_bytes >> 23).bit_length()), 20)


def repeated_starts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and lists of starts of its windows that begin in a document with a smaller id too (several rows a document)."""
    rows = docs.select("doc_id", "text")
    bits = bucket_bits_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sent = map_arrow(rows, _send(bits, window), SENT)
    return sent.groupBy("bucket").applyInPandas(_count(8 - bits // 8), "doc_id long, repeated array<int>")


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            n_words, removed, kept, spans = [], [], [], []
            for text, lists in zip(texts_of(batch), batch.column("repeated").to_pylist()):
                words = text.split()
                merged = merge_intervals(np.fromiter(itertools.chain.from_iterable(lists or ()), np.int64), window)
                gone = sum(b - a for a, b in merged)
                if merged:
                    ends = [0, *(b for _, b in merged)]
                    begins = [*(a for a, _ in merged), len(words)]
                    left = list(itertools.chain.from_iterable(words[a:b] for a, b in zip(ends, begins)))
                else:
                    left = words
                n_words.append(len(words))
                removed.append(gone)
                kept.append(b" ".join(left).decode())
                spans.append([{"begin": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text", "removed"],
            )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed word spans.

    A window counts as repeated if its words also start in a document with a smaller doc_id, judged on the input; repeats
    within one document alone stay. A null or empty text, or one with fewer words than a window, has nothing to remove. A
    document without id takes no part: nothing of it is removed and it makes nothing else a repeat. Rows repeated with the
    same doc_id share their removals. Of documents that hold a window the one with the smallest id keeps it, so ties don't
    arise. Long texts are read whole. An empty table gives an empty result. Further columns of ``docs`` are not read.
    """
    found = repeated_starts(docs, window).groupBy("doc_id").agg(F.collect_list("repeated").alias("repeated"))
    found = found.select(F.col("doc_id").alias("_id"), "repeated")
    rows = docs.select("doc_id", "text")
    joined = rows.join(found, rows.doc_id == found["_id"], "left").select("doc_id", "text", "repeated")
    return map_arrow(
        joined, _remove(window), "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<begin:int,end:int>>"
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The same by comparing the windows' words themselves.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
k AS (SELECT doc_id, x, i, CASE WHEN i <= n - 12 THEN string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) END AS k FROM t),
f AS (SELECT k, min(doc_id) AS first FROM k WHERE k IS NOT NULL GROUP BY k),
r AS (SELECT k.doc_id, x, i, coalesce(first < k.doc_id, false) AS again FROM k LEFT JOIN f USING (k)),
c AS (SELECT doc_id, x, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM r),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by comparing the words themselves; for tests."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = {j for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out
