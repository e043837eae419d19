"""Benchmark decontamination: a BM25 index of the test items, queried with every passage of the training texts.

The index holds the test items; passages are the queries. Scores are divided by an item's score for its own text, so one
threshold fits items of every length. Passages overlap by half and are at least twice as long as the longest item, so a
copied item lies whole within one of them. Retrieval is block-max WAND: documents of the index come in blocks, each
posting list knows its largest weight in each block, and what cannot reach the threshold is skipped. A cheaper bound comes
first, computed for all passages of a text at once: what an item's rare terms give, and all of its frequent ones. Every
retrieved item is verified by the overlap of its question and of its answer with the passage.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .common import cut, discard, free_name, map_arrow, on_workers, table

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be retrieved.
RETRIEVE_FROM = 0.5
#: Shares of the question's and the answer's three-word shingles that must stand in the passage.
QUESTION_FROM = 0.5
ANSWER_FROM = 0.5
SHINGLE = 3
#: Digits that scores are compared to, so that the order in which weights are added doesn't choose a passage.
DIGITS = 9
#: Items in a block of the index.
BLOCK_ITEMS = 8
#: Words from which a passage advances, at least; a passage has twice as many.
STRIDE = 32
#: Items, and words of items, of one index, about; they bound what is broadcast. A larger benchmark is split by a hash of the
#: item into several, each with a pass of its own over the passages.
INDEX_ITEMS = 20_000
INDEX_WORDS = 2_000_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[list[str], list[str]]:
    """Question and answer: the answer is what follows the last question mark or line break, else the last sentence, else the second half."""
    text = (text or "").strip()
    for mark in ("?", "\n", ". "):
        head, found, tail = text.rstrip(".? \n").rpartition(mark)
        if found and len(words_of(head)) >= SHINGLE and words_of(tail):
            return words_of(head), words_of(tail)
    words = words_of(text)
    return words[: -(-len(words) // 2)], words[-(-len(words) // 2) :]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of SHINGLE words; of a shorter text its words as one run."""
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Statistics:
    """Of a benchmark: its items with words, their words, those of the longest, and the items that have each term."""

    items: int
    words: int
    longest: int
    df: dict[str, int]


@dataclass
class Index:
    """Postings of normalised BM25 weights, in order of the items, with block maxima."""

    items: list[int]
    questions: list[set]
    answers: list[set]
    terms: dict[str, int] = field(default_factory=dict)
    docs: list[list[int]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)
    block_max: list[dict[int, float]] = field(default_factory=list)
    stride: int = STRIDE

    @staticmethod
    def build(rows: list[tuple[int, str | None]], whole: Statistics | None = None) -> Index:
        """Items without words cannot be found in a text and are left out. ``whole`` has the statistics of all items, if
        ``rows`` are some of them."""
        rows = sorted((r for r in rows if r[0] is not None and words_of(r[1])), key=lambda r: (r[0], r[1]))
        counts = [Counter(words_of(t)) for _, t in rows]
        parts = [split_item(t) for _, t in rows]
        index = Index([i for i, _ in rows], [shingles(q) for q, _ in parts], [shingles(a) for _, a in parts])
        lengths = [sum(c.values()) for c in counts]
        whole = whole or Statistics(len(rows), sum(lengths), max(lengths, default=0), Counter(t for c in counts for t in c))
        df = {t: whole.df[t] for c in counts for t in c}
        mean = whole.words / max(whole.items, 1)
        index.stride = max(STRIDE, whole.longest)
        idf = {t: math.log(1 + (whole.items - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        index.terms = {t: k for k, t in enumerate(sorted(df))}
        index.docs, index.weights = [[] for _ in df], [[] for _ in df]
        for d, c in enumerate(counts):
            w = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[d] / mean)) for t, n in c.items()}
            own = sum(w.values())
            for t in w:
                index.docs[index.terms[t]].append(d)
                index.weights[index.terms[t]].append(w[t] / own)
        index.block_max = [{} for _ in df]
        for t, (docs, weights) in enumerate(zip(index.docs, index.weights)):
            for d, w in zip(docs, weights):
                index.block_max[t][d // BLOCK_ITEMS] = max(w, index.block_max[t].get(d // BLOCK_ITEMS, 0.0))
        return index

    def search(self, query: list[int], threshold: float = RETRIEVE_FROM) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the distinct terms of ``query`` reaches the threshold, with their scores."""
        lists = [[0, t, max(self.weights[t])] for t in query]
        found = []
        slack = threshold - 1e-9
        while True:
            lists = [x for x in lists if x[0] < len(self.docs[x[1]])]
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            doc = self.docs[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]] == doc:
                pivot += 1
            block = doc // BLOCK_ITEMS
            if sum(self.block_max[x[1]].get(block, 0.0) for x in lists[: pivot + 1]) < slack:
                # Nothing in this block can reach it: go to the next block, or where a further list begins.
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(lists):
                    to = min(to, self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]])
                to = max(to, doc + 1)
                for x in lists[: pivot + 1]:
                    x[0] = bisect.bisect_left(self.docs[x[1]], to, x[0])
            elif self.docs[lists[0][1]][lists[0][0]] == doc:
                score = sum(self.weights[x[1]][x[0]] for x in lists[: pivot + 1])
                if score >= slack:
                    found.append((doc, score))
                for x in lists[: pivot + 1]:
                    x[0] += 1
            else:
                for x in lists[:pivot]:
                    x[0] = bisect.bisect_left(self.docs[x[1]], doc, x[0])


class Gate:
    """Finds the passages that could reach the threshold for some item, for all passages of a text at once.

    Of each item, the lightest terms that together weigh less than the threshold are left out of the lookup; whatever
    reaches the threshold has some of the others, and those weigh at least the threshold less the ones left out.
    """

    def __init__(self, index: Index, threshold: float = RETRIEVE_FROM):
        by_item: list[list[tuple[float, int]]] = [[] for _ in index.items]
        for t, (docs, weights) in enumerate(zip(index.docs, index.weights)):
            for d, w in zip(docs, weights):
                by_item[d].append((w, t))
        postings: list[list[tuple[int, float]]] = [[] for _ in index.docs]
        self.need = np.zeros(len(index.items))
        for d, terms in enumerate(by_item):
            light = 0.0
            for w, t in sorted(terms):
                if light + w < threshold / 2:
                    light += w
                else:
                    postings[t].append((d, w))
            self.need[d] = threshold - light - 1e-9
        self.start = np.cumsum([0, *map(len, postings)])
        flat = [p for ps in postings for p in ps]
        self.item = np.array([p[0] for p in flat], np.int64)
        self.weight = np.array([p[1] for p in flat])

    def passages(self, ids: np.ndarray, stride: int) -> np.ndarray:
        """Numbers of the passages to search, given each word's term (-1: not in the index)."""
        at = np.flatnonzero(ids >= 0)
        terms = ids[at]
        n = self.start[terms + 1] - self.start[terms]
        at, terms, n = at[n > 0], terms[n > 0], n[n > 0]
        if not len(at):
            return at
        last = max(0, -(-(len(ids) - stride) // stride) - 1)
        # Each word is in two passages, the first and the last words of the text in one; a term counts once a passage.
        of = np.concatenate([np.minimum(at // stride, last), np.clip(at // stride - 1, 0, last)])
        pairs = np.unique(of * len(self.start) + np.concatenate([terms, terms]))
        of, terms = pairs // len(self.start), pairs % len(self.start)
        n = self.start[terms + 1] - self.start[terms]
        row = np.repeat(np.arange(len(of)), n)
        post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[terms], n)
        keys, where = np.unique(of[row] * len(self.need) + self.item[post], return_inverse=True)
        bound = np.bincount(where, weights=self.weight[post])
        return np.unique(keys[bound >= self.need[keys % len(self.need)]] // len(self.need))


def passage_bounds(n_words: int, stride: int) -> list[tuple[int, int]]:
    """Passages of twice the stride, each beginning one stride after the one before; the last takes what is left."""
    last = max(0, -(-(n_words - stride) // stride) - 1)
    return [(k * stride, n_words if k == last else (k + 2) * stride) for k in range(last + 1)]


def find_in_text(text: str | None, index: Index, gate: Gate) -> list[tuple[int, int, float, float, float]]:
    """(item, first word of the passage, score, question overlap, answer overlap), the best passage of each verified item."""
    words = words_of(text)
    get = index.terms.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    best: dict[int, tuple] = {}
    candidates = gate.passages(ids, index.stride)
    bounds = passage_bounds(len(words), index.stride) if len(candidates) else []
    for k in candidates:
        begin, end = bounds[k]
        query = [int(t) for t in np.unique(ids[begin:end]) if t >= 0]
        hits = index.search(query)
        if not hits:
            continue
        own = shingles(words[begin:end])
        whole = set(words[begin:end])
        for d, score in hits:
            overlaps = []
            for side in (index.questions[d], index.answers[d]):
                there = sum(s in own if len(s) == SHINGLE else all(w in whole for w in s) for s in side)
                overlaps.append(there / len(side) if side else 1.0)
            if overlaps[0] >= QUESTION_FROM and overlaps[1] >= ANSWER_FROM:
                best[d] = max(best.get(d, (-1.0,)), (round(score, DIGITS), -begin, *overlaps))
    return [(index.items[d], -b, s, q, a) for d, (s, b, q, a) in sorted(best.items())]


FOUND = "doc_id long, item_id long, passage_start int, score double, question_overlap double, answer_overlap double"
HASHED = FOUND + ", text_sha256 string"


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t) for t in batch.column("text").to_pylist()]
        terms = pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, words), pa.int64()), terms], names=["item_id", "text", "n_words", "terms"])


def indexes(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(part, index) with the pickled index of each part of the items, and the number of parts.

    Document frequencies, item count, mean length and longest item are those of the whole benchmark, so a score doesn't
    depend on the part that an item is in. The indexes are built in tasks; only three numbers come to the driver.
    """
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct()
    items = cut(map_arrow(items, _item_terms, "item_id long, text string, n_words long, terms array<string>").where("n_words > 0"))
    n, words, longest = items.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.max("n_words"), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-words // INDEX_WORDS))
    placed = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int").alias("part"), "item_id", "text", "terms")
    terms = placed.select("part", F.explode("terms").alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.distinct().join(df, "term").select("part", F.lit(None).cast("long").alias("item_id"), F.col("term").alias("text"), "df")
    rows = placed.select("part", "item_id", "text", F.lit(None).cast("long").alias("df")).unionByName(known)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts, counts = (table.column(c).to_pylist() for c in ("item_id", "text", "df"))
        whole = Statistics(n, words, longest, {t: k for i, t, k in zip(ids, texts, counts) if i is None})
        index = Index.build([(i, t) for i, t in zip(ids, texts) if i is not None], whole)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(index)], pa.binary())})

    built = cut(rows.groupBy("part").applyInArrow(build, "part int, index binary"))
    discard(items)
    return built, parts


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of find_leaks, each with the SHA-256 of its document's text."""
    spark = docs.sparkSession
    on_workers(spark)
    built, parts = indexes(benchmark)
    rows = docs.select("doc_id", "text")
    found = None
    for part_no in range(parts):
        row = built.where(F.col("part") == part_no).first()
        shared = spark.sparkContext.broadcast(bytes(row["index"]) if row else pickle.dumps(Index.build([])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = pickle.loads(shared.value)
            gate = Gate(index)
            for batch in batches:
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    hits = find_in_text(text, index, gate) if text else []
                    if hits:
                        digest = hashlib.sha256(text.encode()).hexdigest()
                        out.extend((doc_id, *hit, digest) for hit in hits)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
                columns = list(zip(*out)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in HASHED.split(", ")])

        part = map_arrow(rows, run, HASHED)
        if parts == 1:
            return part
        # One index after another: what a part finds, a few rows, is written before its index is let go of everywhere.
        part = cut(part)
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    discard(built)
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, passage_start, score, question_overlap, answer_overlap.

    Words are runs of letters, digits and underscores, lower-cased. Of several passages that hold an item the one with the
    highest score counts, then the earliest. Null or empty texts hold nothing; items without words or without id are never
    found; a repeated item row is reported once, a repeated document row each time. Of items that score alike all are
    found. Long texts are searched whole, passage by passage. Empty tables give an empty result. One index of about
    INDEX_ITEMS items and INDEX_WORDS words goes through the driver and is broadcast at a time; a larger benchmark makes
    several, all with the statistics of the whole, whose passes run one after another. ``docs`` is read for doc_id and text only.
    """
    return _leaks(docs, benchmark).drop("text_sha256")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their columns of any name; each is decided by its own text, whatever its id.

    Rows of null or empty text stay. An empty benchmark drops nothing.
    """
    key, digest = free_name(docs, "_leak_id"), free_name(docs, "_leak_sha")
    leaks = _leaks(docs, benchmark).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.sha2(docs["text"], 256) == F.col(digest))
    return docs.join(leaks.hint("shuffle_hash"), same, "left_anti")


def brute_force(docs: list[tuple[int, str | None]], rows: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """(doc_id, item_id) by scoring every passage against every item; for tests."""
    index = Index.build(rows)
    out = set()
    for doc_id, text in docs:
        words = words_of(text)
        for begin, end in passage_bounds(len(words), index.stride):
            own, whole = shingles(words[begin:end]), set(words[begin:end])
            scores: Counter = Counter()
            for w in whole:
                if w in index.terms:
                    for d, x in zip(index.docs[index.terms[w]], index.weights[index.terms[w]]):
                        scores[d] += x
            for d, x in scores.items():
                if x >= RETRIEVE_FROM - 1e-9:
                    sides = [sum(s in own if len(s) == SHINGLE else whole.issuperset(s) for s in side) / len(side) if side else 1.0 for side in (index.questions[d], index.answers[d])]
                    if sides[0] >= QUESTION_FROM and sides[1] >= ANSWER_FROM:
                        out.add((doc_id, index.items[d]))
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("score", F.round("score", 6))


def _sql_split(mark: str, rest: str) -> str:
    """SQL: question and answer of a text t by its last mark, if the question has words enough and the answer any."""
    parts = [f"regexp_extract(t, '(?s)^(.*){mark}(.*)$', {i})" for i in (1, 2)]
    words = [f"regexp_extract_all(lower({p}), '{_SQL_WORD}')" for p in parts]
    return f"CASE WHEN regexp_matches(t, '{mark}') AND len({words[0]}) >= {SHINGLE} AND len({words[1]}) >= 1 THEN [{words[0]}, {words[1]}] ELSE {rest} END"


_SQL_WORD = r"[\p{L}\p{N}_]+"
_SQL_HALVES = "[w[1:((len(w) + 1) // 2)], w[((len(w) + 1) // 2 + 1):len(w)]]"


def _sql_shingles(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(1, len({words}) - {SHINGLE - 1}) + 1), lambda i: array_to_string({words}[i:(i + {SHINGLE - 1})], ' ')))"


def _sql_overlap(side: str) -> str:
    """SQL: the share of a side's shingles that the passage p has; of a side too short for one, whether it has all its words."""
    short = f"CASE WHEN list_has_all(p, {side}) THEN 1.0 ELSE 0.0 END"
    return f"CASE WHEN len({side}) = 0 THEN 1.0 WHEN len({side}) < {SHINGLE} THEN {short} ELSE len(list_intersect({_sql_shingles(side)}, {_sql_shingles('p')})) / len({_sql_shingles(side)}) END::double"


#: The same by scoring every passage against every item that shares a word with it.
OP2_SQL = f"""
WITH i AS (SELECT row_number() OVER () AS n, item_id, w, {_sql_split("[?]", _sql_split("[\\n]", _sql_split("[.] ", _SQL_HALVES)))} AS sides
  FROM (SELECT item_id, regexp_extract_all(lower(text), '{_SQL_WORD}') AS w, regexp_replace(trim(text, E' \\n\\t\\r'), '[.? \\n]+$', '') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) WHERE len(w) > 0),
s AS (SELECT count(*) AS items, avg(len(w)) AS mean, greatest({STRIDE}, max(len(w))) AS stride FROM i),
c AS (SELECT n, unnest(w) AS term, len(w) AS size FROM i), f AS (SELECT n, term, size, count(*) AS tf FROM c GROUP BY n, term, size),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
x AS (SELECT n, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * size / mean)) AS x FROM f JOIN df USING (term), s),
v AS (SELECT n, term, x / sum(x) OVER (PARTITION BY n) AS v FROM x),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_SQL_WORD}') AS w FROM documents WHERE text <> ''),
l AS (SELECT doc_id, w, stride, greatest(0, ceil((len(w) - stride) / stride) - 1)::bigint AS last FROM d, s WHERE len(w) > 0),
b AS (SELECT doc_id, w, stride, last, unnest(range(0, last + 1)) AS k FROM l),
p AS (SELECT doc_id, k * stride AS start, w[(k * stride + 1):(CASE WHEN k = last THEN len(w) ELSE (k + 2) * stride END)] AS p FROM b),
q AS (SELECT doc_id, start, unnest(list_distinct(p)) AS term FROM p),
h AS (SELECT doc_id, start, n, round(sum(v), {DIGITS}) AS score FROM q JOIN v USING (term) GROUP BY doc_id, start, n HAVING sum(v) >= {RETRIEVE_FROM} - 1e-9),
o AS (SELECT doc_id, item_id, n, start, score, {_sql_overlap("sides[1]")} AS question_overlap, {_sql_overlap("sides[2]")} AS answer_overlap FROM h JOIN p USING (doc_id, start) JOIN i USING (n)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY score DESC, start) AS place FROM o WHERE question_overlap >= {QUESTION_FROM} AND answer_overlap >= {ANSWER_FROM})
SELECT doc_id, item_id, start::int AS passage_start, round(score, 6) AS score, question_overlap, answer_overlap FROM r WHERE place = 1
"""
