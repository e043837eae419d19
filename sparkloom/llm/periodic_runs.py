"""Runs of words that repeat with a period, found by bit-parallel lags.

A run of period q is a stretch of words in which words q apart are equal. The words of a text are numbered, and the
numbers' bits make planes: one integer for each bit, as wide as the text. A plane XORed with itself shifted by q shows
where that bit differs q apart; the OR over the planes shows where the words differ, and a run is a long stretch of zeros
there. Long stretches are isolated by ANDs with shifts that double. After the first planes most lags have none left.

A word of a run of exponent 4 stands in it four times at least, so words that are rarer in a piece of the text cut it in
two, again and again; only pieces without such words are searched. The time of a piece grows with the square of its
words, divided by the bits of a machine word: a piece of 20,000 words takes a fraction of a second.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from .common import map_arrow, table, texts_of

#: A run has at least this many periods and this many words.
EXPONENT, LEAST_WORDS = 4, 6
#: After so many planes a lag is given up if no long stretch is left; after all of them stretches become runs.
LOOK_AFTER = (1, 2, 4)


def long_zeros(bits: int, width: int, least: int) -> int:
    """The positions from which on ``least`` bits of ``bits`` are zero, as an integer; its lowest ``width`` bits count."""
    left, have = ((1 << width) - 1) & ~bits, 1
    while have < least and left:
        step = min(have, least - have)
        left &= left >> step
        have += step
    return left


def planes_of(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers, with a bit for each position."""
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(int(ids.max()).bit_length())]


def _pieces(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches (first position, numbers from 0 on) in which every word occurs EXPONENT times at least."""
    todo = [(0, ids)]
    while todo:
        at, part = todo.pop()
        if len(part) < LEAST_WORDS:
            continue
        _, part, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[part] < EXPONENT)
        if not len(rare):
            yield at, part
            continue
        edges = np.concatenate(([-1], rare, [len(part)]))
        for k in np.flatnonzero(np.diff(edges) > LEAST_WORDS):
            todo.append((at + int(edges[k]) + 1, part[edges[k] + 1 : edges[k + 1]]))


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period.

    The period is the smallest of the stretch, which is as long as the period allows, and at least EXPONENT periods and
    LEAST_WORDS words.
    """
    found = []
    for at, part in _pieces(ids):
        n, planes = len(part), planes_of(part)
        spans: set[tuple[int, int]] = set()
        for q in range(1, n // EXPONENT + 1):
            width, least = n - q, max(LEAST_WORDS - q, (EXPONENT - 1) * q)
            if least > width:
                break
            differ, left = 0, -1
            for k, plane in enumerate(planes, 1):
                differ |= plane ^ (plane >> q)
                if k in LOOK_AFTER and not (left := long_zeros(differ, width, least)):
                    break
            if not left:
                continue
            left, begun = long_zeros(differ, width, least), 0
            while left:
                skip = (left & -left).bit_length() - 1
                left >>= skip
                ones = (~left & (left + 1)).bit_length() - 1
                left >>= ones
                start, length = begun + skip, ones + least - 1 + q
                begun = start + ones
                # The stretch of a smaller period that divides this one came before.
                if (start, length) not in spans:
                    spans.add((start, length))
                    found.append((at + start, length, q))
            if (0, n) in spans:
                break  # within a stretch of one period no other has room
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie behind the first period of a run."""
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        kept.extend(words[at : max(at, begin)])
        at = max(at, end)
    return kept + words[at:]


def numbered(words: list[bytes]) -> np.ndarray:
    """The words' numbers, in the order of their first places."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


#: Rows of a batch whose results are in memory together.
ROWS = 500
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, strongest struct<start:long,length:long,period:long>, collapsed string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("start", "length", "period")
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            counts, runs, best, texts = [], [], [], []
            for text in texts_of(part):
                words = text.split()  # of bytes: at the six white spaces of ASCII alone
                found = runs_of(numbered(words)) if len(words) >= LEAST_WORDS else []
                counts.append(len(words))
                runs.append([dict(zip(names, r)) for r in found])
                best.append(dict(zip(names, strongest(found))) if found else None)
                texts.append(b" ".join(collapse(words, found)))
            columns = [
                part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(best, RUN), pa.array(texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every text (doc_id, text) and what is left of it without their repetitions.

    Returns a row for each row: doc_id, n_words, runs (start, length, period: word numbers from 0; by start, then period),
    strongest (the run of most periods, of equal ones that which starts first, then the shorter period; null without
    runs) and collapsed (the words that lie behind no run's first period, joined by single spaces). Words are what stands
    between space, tab, line feed, vertical tab, form feed and carriage return. A null or empty text has no words and an
    empty ``collapsed``; texts of any length are searched whole. Rows are taken one by one, so null or repeated ids and
    repeated rows give a row each. Further columns, whatever their names, aren't read. An empty table gives an empty one.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _find, SCHEMA)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or in one of ten documents (by the CRC-32 of the id) its words with their end replaced by a repetition."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = F.col("strongest")
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _levels(n: int) -> str:
    """Hashes of all windows of 1, 2, 4, ... words, each from two of the level before, and where each stands next."""
    out = []
    for k in range(n):
        if k:
            out.append(f"""h{k} AS MATERIALIZED (
  SELECT doc_id, i, hash(h, other) AS h FROM (SELECT doc_id, i, h, lead(h, {1 << (k - 1)}) OVER (PARTITION BY doc_id ORDER BY i) AS other FROM h{k - 1}) WHERE other IS NOT NULL
), """)
        out.append(f"""s{k} AS MATERIALIZED (
  SELECT doc_id, i, q, {1 << k} AS w FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS q FROM h{k}) WHERE q > {(1 << k) // 2} AND q <= {1 << k}
), """)
    return "".join(out)


#: Windows of up to 2^17 words: enough for texts of half a million words.
_LEVELS = 18
#: In a run of period q a window of at least q words stands next exactly q words later, so runs are stretches of positions
#: whose window of the next power of two has one distance. CRC-32 is worked out bit by bit.
OP13_SQL = f"""
WITH ids AS (
  SELECT doc_id, text, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS c
  FROM documents
), w AS (
  SELECT doc_id, xor(c, 4294967295) AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM ids
), g AS (
  SELECT doc_id, words, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a, (h // 10) % 8 AS e FROM w
), p AS (
  SELECT doc_id, words, n, a, 1 + (n - a) // (3 + e) AS p FROM g
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(n)) AS i FROM p
), targets AS (
  SELECT doc_id, i, CASE WHEN i >= a THEN a + (i - a) % p ELSE i END AS j FROM (SELECT doc_id, a, p, unnest(range(n)) AS i FROM p)
), words AS MATERIALIZED (
  SELECT t.doc_id, t.i, placed.word FROM targets t JOIN placed ON placed.doc_id = t.doc_id AND placed.i = t.j
), h0 AS MATERIALIZED (SELECT doc_id, i, hash(word) AS h FROM words),
{_levels(_LEVELS)}same AS (
  {" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(_LEVELS))}
), islands AS (
  SELECT doc_id, q, w, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), runs AS MATERIALIZED (
  SELECT doc_id, min(i) AS start, max(i) - min(i) + w + q AS length, q AS period FROM islands GROUP BY doc_id, q, w, island
  HAVING max(i) - min(i) + w + q >= greatest(6, 4 * q)
), best AS (
  SELECT doc_id, arg_max({{'start': start, 'length': length, 'period': period}}, (length / period, -start, -period)) AS b, count(*) AS n_runs,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY doc_id
), marks AS (
  SELECT doc_id, i, sum(d) AS d FROM (
    SELECT doc_id, start + period AS i, 1 AS d FROM runs UNION ALL SELECT doc_id, start + length, -1 FROM runs) GROUP BY doc_id, i
), kept AS (
  SELECT doc_id, i, word, coalesce(sum(d) OVER (PARTITION BY doc_id ORDER BY i), 0) AS inside FROM words LEFT JOIN marks USING (doc_id, i)
), texts AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM kept WHERE inside = 0 GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM p LEFT JOIN best USING (doc_id) LEFT JOIN texts USING (doc_id)
"""
