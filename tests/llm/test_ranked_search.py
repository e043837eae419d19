import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import ranked_search as R


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def by_definition(docs, items, k=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    counts = [(d, Counter(words(t))) for d, t in docs if words(t)]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t]
            )
            if score > 0:
                scores.append((-score, d is not None, d or 0, d))
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


lists = st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 4), min_size=1, max_size=40), min_size=1, max_size=6)


def forest(postings):
    treaps = R.Treaps()
    roots = [treaps.add(np.array(sorted(p)), np.array([p[d] for d in sorted(p)])) for p in postings]
    treaps.close()
    return treaps, roots


@settings(max_examples=300, deadline=None)
@given(lists, st.lists(st.sets(st.integers(0, 5), min_size=1), min_size=1, max_size=4), st.integers(1, 6))
def test_walk_finds_the_best(postings, queries, k):
    """Several queries at once, weights with many ties, by adding up all of them."""
    treaps, roots = forest(postings)
    queries = [[i for i in sorted(q) if i < len(postings)] or [0] for q in queries]
    expected = []
    for q in queries:
        sums = Counter()
        for i in q:
            sums.update(postings[i])
        expected.append([(s, d) for d, s in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k]])
    assert R.best(treaps, [[roots[i] for i in q] for q in queries], k, 60, [1] * len(queries)) == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 500), st.integers(1, 5), min_size=1, max_size=200), min_size=1, max_size=3))
def test_treap_orders(postings):
    t, roots = forest(postings)
    for root, posting in zip(roots, postings):
        order, stack = [], [(root, False)]
        while stack:
            node, seen = stack.pop()
            if node < 0:
                continue
            if seen:
                order.append(t.docs[node])
                continue
            assert all(child < 0 or t.weights[child] <= t.weights[node] for child in (t.left[node], t.right[node]))
            stack += [(t.right[node], False), (node, True), (t.left[node], False)]
        assert order == sorted(posting)


def test_few_nodes_are_seen(monkeypatch):
    """Most of a list of 20,000 is left, and equal weights make no chain."""
    rng, seen = np.random.default_rng(1), []
    treaps = R.Treaps()
    roots = [treaps.add(np.arange(20_000), rng.integers(1, 1000, 20_000) ** 3), treaps.add(np.arange(0, 20_000, 2), np.full(10_000, 7))]
    treaps.close()
    split = R.Treaps.split
    monkeypatch.setattr(R.Treaps, "split", lambda self, node, *a: seen.append(len(node)) or split(self, node, *a))
    assert len(R.best(treaps, [roots], 10, 19_999, [1])[0]) == 10
    assert sum(seen) < 2000 and len(seen) < 40


ITEMS = [(1, "Short text, TEXT"), (2, None), (3, ""), (4, "nowhere-to-be-found qq"), (5, "ünïcode trants twice"), (5, "ünïcode trants twice"), (None, "short"), (6, "tran mota kaes lire other text")]


@pytest.mark.parametrize("shard, block", [(16_384, 100_000), (2, 3)])
def test_rows_of_all_kinds(spark, docs, rows, monkeypatch, shard, block):
    monkeypatch.setattr(R, "SHARD_DOCS", shard)
    monkeypatch.setattr(R, "BLOCK_TERMS", block)
    monkeypatch.setattr(R, "STEP_POSTINGS", block)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    more = spark.createDataFrame([(None, "short notes of text"), (None, None), (30, "Text!" * 400)], "doc_id long, text string")
    got = R.search(R.build_index(docs.select("doc_id", "text").union(more)), items)
    expected = by_definition([*rows, *[tuple(r) for r in more.collect()]], ITEMS)
    found = [tuple(r) for r in got.collect()]
    # Of a row that stands twice, and of an item that stands twice, the rows are told apart by nothing.
    assert sorted(found, key=repr) == expected


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert R.search(R.build_index(empty), items).collect() == []
    assert R.search(R.build_index(docs), items.limit(0)).collect() == []
    assert R.search(R.build_index(docs), items.where("item_id in (2, 3)")).collect() == []
    none = docs.selectExpr("doc_id", "CAST(NULL AS string) AS text")
    assert R.search(R.build_index(none), items).dtypes == R.search(R.build_index(docs), items).dtypes


def test_query_by_brute_force(spark, tiny):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{tiny}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted((tuple(r) for r in R.op11_ranked_search(spark, tiny).collect()), key=repr) == by_definition(docs, items)
