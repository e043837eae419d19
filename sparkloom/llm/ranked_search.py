"""Ranked search of words with inverted treaps.

The index is a table: for each shard of documents and each term a list of the documents that hold it, in the order of
doc_id, with the occurrences. A search turns the lists of its terms into treaps, one for each shard and term: search trees
by document whose every node weighs no less than those below it. All treaps of a query are walked at once over ranges of
documents. The roots' weights sum up to a bound for the range; a range that can't reach the best k so far is left with all
that lies below it, others are split at the heaviest root's document, which is scored on the way.

Each shard gives its best k, and Spark ranks those. Documents, postings and queries stay in tables: what a task holds is
one shard and one block of queries, both of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from .common import LOWER, UPPER, cut, discard, map_arrow, table, texts_of

#: A shard ends at so many documents, or so many terms of documents (a single longer document is one by itself).
SHARD_DOCS, SHARD_POSTINGS = 16_384, 3_000_000
#: Queries of a block have about so many terms together.
BLOCK_TERMS = 100_000
#: Postings of the queries that are walked together.
STEP_POSTINGS = 2_000_000
TOP = 10

#: Letters, digits and all bytes beyond ASCII make terms; A-Z are lower-cased.
_KEPT = (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in their order, with repeats."""
    return text.translate(_TERMS).split()


INDEX = "shard long, term string, docs array<int>, counts array<int>, ids array<long>"


def _shard(number: int, ids: list, lengths: list[int], found: list[tuple[np.ndarray, np.ndarray]], terms: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: its documents (term '', their lengths in ``docs``), then each term's postings."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
    place = np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids), dtype=np.int32)
    docs = np.concatenate([np.full(len(t), place[i], np.int32) for i, (t, _) in enumerate(found)])
    each, counts = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found])
    by_term = np.lexsort((docs, each))
    edges = np.concatenate(([0], np.cumsum(np.bincount(each, minlength=len(terms))))).astype(np.int32)
    whole = np.array([lengths[i] for i in order], np.int32)
    kinds = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("docs", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    first = [[number], [""], [whole], [None], [[ids[i] for i in order]]]
    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(first, kinds)], schema=kinds)
    docs, counts = docs[by_term], counts[by_term].astype(np.int32)
    for at in range(0, len(terms), 50_000):
        some = edges[at : at + 50_001]
        lists = [pa.ListArray.from_arrays(some - some[0], column[some[0] : some[-1]]) for column in (docs, counts)]
        n = len(some) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), pa.array(terms[at : at + n], pa.binary()).cast(pa.string()), *lists, pa.nulls(n, pa.list_(pa.int64()))], schema=kinds
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, postings = TaskContext.get().partitionId() << 32, 0
    ids, lengths, found = [], [], []
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            words = terms_of(text)
            if not words:
                continue
            numbers, counts = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
            ids.append(doc_id)
            lengths.append(len(words))
            found.append((numbers, counts))
            postings += len(numbers)
            if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield from _shard(number, ids, lengths, found, list(known))
                number, postings = number + 1, 0
                ids, lengths, found = [], [], []
                known.clear()
    if ids:
        yield from _shard(number, ids, lengths, found, list(known))


def build_index(docs: DataFrame) -> DataFrame:
    """The index (INDEX) of doc_id and text, as a table in the shared folder; documents without terms aren't in it.

    Null and repeated doc_ids and repeated rows are documents of their own. Further columns aren't read. Whole texts of
    any length are indexed. An empty table gives an empty index.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(map_arrow(rows, _build, INDEX))


class Treaps:
    """Treaps of a shard, one after another in flat arrays: search trees by document, heaviest first.

    Documents of equal weight are heaped by a fixed shuffle of their numbers, or equal weights would make a long chain.
    """

    def __init__(self) -> None:
        self._docs, self._weights, self._left, self._right, self.size = [], [], [], [], 0

    def add(self, docs: np.ndarray, weights: np.ndarray) -> int:
        """The root of a new treap; documents ascend, and weights are below 2^39."""
        shuffled = (docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        heap = (weights.astype(np.int64) * (1 << 24) + shuffled.astype(np.int64)).tolist()
        left, right, spine = [-1] * len(heap), [-1] * len(heap), []
        for i, key in enumerate(heap):
            below = -1
            while spine and heap[spine[-1]] < key:
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        base, self.size = self.size, self.size + len(heap)
        for parts, values in ((self._left, left), (self._right, right)):
            links = np.array(values)
            parts.append(np.where(links < 0, -1, links + base))
        self._docs.append(docs)
        self._weights.append(weights)
        return base + spine[0]

    def close(self) -> None:
        """After the last treap."""
        self.docs, self.weights, self.left, self.right = (np.concatenate(c).astype(np.int64) for c in (self._docs, self._weights, self._left, self._right))

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each node the heaviest one from it downwards whose document lies from ``low`` to ``high``, else -1."""
        node = node.copy()
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            at = self.docs[node[todo]]
            under, over = at < low[todo], at > high[todo]
            todo, under = todo[under | over], under[under | over]
            node[todo] = np.where(under, self.right[node[todo]], self.left[node[todo]])
            todo = todo[node[todo] >= 0]
        return node

    def split(self, node: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The weight of ``doc`` from each node downwards (0 if it isn't there), and the heaviest nodes before and after it."""
        weight, before, after = np.zeros(len(node), np.int64), np.full(len(node), -1), np.full(len(node), -1)
        node, todo = node.copy(), np.arange(len(node))
        while len(todo):
            here = node[todo]
            at, goal = self.docs[here], doc[todo]
            less, more = at < goal, at > goal
            same = ~(less | more)
            first = less & (before[todo] < 0) & (at >= low[todo])
            before[todo[first]] = here[first]
            first = more & (after[todo] < 0) & (at <= high[todo])
            after[todo[first]] = here[first]
            ends, where = todo[same], here[same]
            if len(ends):
                weight[ends] = self.weights[where]
                for side, link, a, b in ((before, self.left, low[ends], doc[ends] - 1), (after, self.right, doc[ends] + 1, high[ends])):
                    side[ends] = np.where(side[ends] < 0, self.within(link[where], a, b), side[ends])
            node[todo] = np.where(less, self.right[here], self.left[here])
            todo = todo[~same]
            todo = todo[node[todo] >= 0]
        return weight, before, after


def best(treaps: Treaps, queries: list[list[int]], k: int, last: int, reach: list[int]) -> list[list[tuple[int, int]]]:
    """For each query, a list of roots, (score, document) of its k documents from 0 to ``last`` with the highest sums of
    weights, smaller documents first among equals.

    Only scores from the query's ``reach`` on count; k documents at least must be known to have it if it is over 1. The
    ranges of all queries go down one step at a time. No node is in two ranges of a query, so a step holds no more nodes
    than the treaps of its queries.
    """
    reach = np.array(reach, np.int64)
    query, low, high = np.arange(len(queries)), np.zeros(len(queries), np.int64), np.full(len(queries), last, np.int64)
    of = np.repeat(query, [len(q) for q in queries])  # the range of each node, ascending
    nodes = np.array([n for q in queries for n in q], np.int64)
    found = np.empty((3, 0), np.int64)  # query, score and document of those that can still be among the best
    while len(nodes):
        # Ranges that can't reach the best so far are left.
        bound = np.bincount(of, treaps.weights[nodes], len(query))
        alive = bound >= reach[query]
        nodes, of = nodes[alive[of]], (np.cumsum(alive) - 1)[of[alive[of]]]
        query, low, high = query[alive], low[alive], high[alive]
        if not len(nodes):
            break
        # The others are split at the heaviest document, which is scored.
        weights = treaps.weights[nodes]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        heaviest = np.flatnonzero(weights == np.maximum.reduceat(weights, begin)[of])
        heaviest = heaviest[np.flatnonzero(np.diff(of[heaviest], prepend=-1))]
        doc = treaps.docs[nodes[heaviest]]
        weight, before, after = treaps.split(nodes, doc[of], low[of], high[of])
        score = np.bincount(of, weight, len(query)).astype(np.int64)
        new = score >= reach[query]
        found = np.concatenate([found, [query[new], score[new], doc[new]]], axis=1)
        found = found[:, np.lexsort((found[2], -found[1], found[0]))]
        rank = np.arange(found.shape[1]) - np.searchsorted(found[0], found[0])
        reach[found[0][rank == k - 1]] = np.maximum(reach[found[0][rank == k - 1]], found[1][rank == k - 1])
        found = found[:, rank < k]
        sides = np.concatenate([before, after])
        held = np.flatnonzero(sides >= 0)
        of = np.concatenate([2 * of, 2 * of + 1])[held]
        order = np.argsort(of, kind="stable")
        nodes, of = sides[held][order], of[order]
        kept, of = np.unique(of, return_inverse=True)
        parent, right = kept >> 1, (kept & 1).astype(bool)
        low, high, query = np.where(right, doc[parent] + 1, low[parent]), np.where(right, high[parent], doc[parent] - 1), query[parent]
    out: list[list[tuple[int, int]]] = [[] for _ in queries]
    for q, score, doc in found.T.tolist():
        out[q].append((score, doc))
    return out


def saturated(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a term's occurrences in documents of these lengths give, in whole numbers."""
    if n_docs * int(lengths.max(initial=0)) >= 1 << 56:
        lengths = lengths.astype(object)
    share = 100 - 90 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * counts // (1000 * counts + 8 * share.astype(np.int64))).astype(np.int64)


Asked = tuple[int, list[tuple[int, int, int]]]


def _parts(queries: list[Asked]) -> Iterator[list[Asked]]:
    """Queries with terms (root, sure weight, size) that are walked together: their lists hold STEP_POSTINGS at most, but
    for a single longer query."""
    part, held = [], 0
    for query, terms in queries:
        if not terms:
            continue
        size = sum(n for _, _, n in terms)
        if part and held + size > STEP_POSTINGS:
            yield part
            part, held = [], 0
        part.append((query, terms))
        held += size
    if part:
        yield part


FOUND = "query long, doc_id long, score long"


def _search(n_docs: int, n_terms: int, k: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        terms = group.column("term").to_pylist()
        head = terms.index("")
        lengths, ids = group.column("docs")[head].values.to_numpy(zero_copy_only=False).astype(np.int64), group.column("ids")[head].as_py()
        queries, rows = group.column("queries")[head].as_py(), {t: i for i, t in enumerate(terms)}
        treaps, known = Treaps(), {}
        for term in dict.fromkeys(t for q in queries for t in q["terms"]):
            at = rows.get(term)
            weight = 0 if at is None else group.column("weight")[at].as_py()
            if weight > 0:
                docs, counts = (group.column(c)[at].values.to_numpy(zero_copy_only=False) for c in ("docs", "counts"))
                weights = weight * saturated(counts.astype(np.int64), lengths[docs], n_docs, n_terms)
                # k documents have at least this much by the term alone.
                sure = int(np.partition(weights, len(weights) - k)[len(weights) - k]) if len(weights) >= k else 1
                known[term] = treaps.add(docs, weights), max(sure, 1), len(docs)
        out: tuple[list, ...] = ([], [], [])
        if known:
            treaps.close()
        for part in _parts([(q["query"], [known[t] for t in q["terms"] if t in known]) for q in queries]):
            results = best(treaps, [[root for root, _, _ in terms] for _, terms in part], k, len(ids) - 1, [max(sure for _, sure, _ in terms) for _, terms in part])
            for (query, _), result in zip(part, results):
                for score, doc in result:
                    for column, value in zip(out, (query, ids[doc], score)):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [[t.decode() for t in dict.fromkeys(terms_of(text))] for text in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").cast(pa.int64()), pa.array(terms, pa.list_(pa.string()))], names=["item_id", "terms"])


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of an index for each item (item_id, text): item_id, rank (from 1), doc_id and score.

    A term's weight is floor(1000 * ln((2N + 2) / (2 df + 1))), with N documents that have terms, df of them with this
    one; its part of a score is (10^9 tf) div (1000 tf + 8 m), with m = 10 + (90 n N) div L for a document of n terms of L in
    all. Each different term of an item counts once. Documents without a score above 0 aren't found; equal scores rank by
    doc_id, nulls first, and equal rows in any order. Null and empty items, and those whose terms are nowhere, have no rows.
    Every row of items is a query of its own, so items repeated with their id repeat their rows. An empty index or no items
    give no rows. Further columns aren't read. The counts of the corpus, one row, reach the driver.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    queries = cut(map_arrow(rows, _query_terms, "item_id long, terms array<string>").where(F.size("terms") > 0).withColumn("query", F.monotonically_increasing_id()))
    spark, documents = index.sparkSession, index.where("term = ''")
    lengths = F.aggregate("docs", F.lit(0).cast("long"), lambda n, x: n + x)
    counts = documents.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("docs"), F.coalesce(F.sum(lengths), F.lit(0)).alias("terms")).first()
    asked = queries.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    if not counts["docs"] or not asked:
        discard(queries)
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    blocks = -(-asked // BLOCK_TERMS)
    queries_in = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    wanted = queries_in.select("block", F.explode("terms").alias("term")).distinct()
    postings = index.where("term != ''").join(wanted.select("term").distinct(), "term")
    frequency = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    ratio = F.lit(2.0 * counts["docs"] + 2) / (2 * F.col("df") + 1)
    weights = wanted.join(frequency.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")), "term")
    # A shard's documents go to each block with the queries of the block, its postings to those that ask for the term.
    asks = queries_in.groupBy("block").agg(F.collect_list(F.struct("query", "terms")).alias("queries"))
    every = documents.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))
    parts = every.join(asks, "block").select("shard", "block", "term", "docs", "counts", "ids", F.lit(None).cast("long").alias("weight"), "queries")
    parts = parts.unionByName(index.join(weights, "term"), allowMissingColumns=True)
    found = parts.groupBy("shard", "block").applyInArrow(_search(counts["docs"], counts["terms"], k), FOUND)
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_SPLIT = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH t AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
q AS (SELECT DISTINCT item_id, unnest({_SPLIT}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * c.N + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n.n * c.N) // c.L))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id
), r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
