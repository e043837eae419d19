import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing as P


@settings(max_examples=200)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20))
def test_plan_places_every_item_once(histogram):
    groups = P.plan_groups(histogram, 60)
    placed: Counter = Counter()
    for pattern, n in groups:
        assert n > 0 and pattern and sum(pattern) <= 60
        for size in pattern:
            placed[size] += n
    assert placed == Counter(histogram)
    used = sum(n for _, n in groups)
    total = sum(s * n for s, n in histogram.items())
    assert used >= math.ceil(total / 60)


def test_plan_pairs_large_items_and_fills_gaps():
    assert sum(n for _, n in P.plan_groups({1200: 5, 800: 5, 48: 5})) == 5
    assert P.plan_groups({}) == []


def test_cut_lengths():
    assert P.cut_lengths(5, 4) == [(0, 1), (1, 4)]
    assert P.cut_lengths(8, 4) == [(0, 4), (4, 4)]
    assert P.cut_lengths(1, 4) == [(0, 1)]


def check_places(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_documents_are_whole_and_ids_are_the_tokenizers(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = P.pack_documents(docs).collect()
    check_places(got, P.CAPACITY)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == {d for d, _ in rows}
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        times = len([1 for e, _ in rows if e == d])
        expected = Counter((k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.cut_lengths(len(ids))))
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == Counter({x: times * n for x, n in expected.items()})


def test_sequences_hold_the_ids(docs):
    packed = P.pack(P.token_pieces(docs)).cache()
    whole = {r.sequence_id: r for r in P.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id].ids
        assert ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert len(ids) == 4 * whole[r.sequence_id].n_tokens


def test_many_equal_lengths_and_empty_table(spark, empty, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_SALT", 10)
    items = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "CAST(IF(id % 3 = 0, 700, 300) AS long) AS length")
    got = P.pack(items).collect()
    assert len(got) == 3000
    assert check_places(got, P.CAPACITY) <= 670
    assert P.pack_documents(empty).collect() == []


def fewest(items, capacity):
    """The smallest number of sequences, by trying all ways."""
    best = len(items)

    def place(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + left[0] <= capacity and bins[i] not in bins[:i]:
                place(left[1:], [*bins[:i], bins[i] + left[0], *bins[i + 1 :]])
        place(left[1:], [*bins, left[0]])

    place(sorted(items, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=10))
def test_plans_are_close_to_the_smallest(items):
    used = sum(n for _, n in P.plan_groups(Counter(items), 30))
    assert fewest(items, 30) <= used <= max(fewest(items, 30) * 11 / 9 + 1, used if len(items) == 1 else 0)


def test_columns_of_any_name_pass(spark):
    names = ["doc_id", "piece", "length", "sequence_id", "offset", "salt", "row", "size", "number", "_salt", "a.b"]
    rows = [(i, 0, 300 + i, "s", "o", i, i, i, i, i, i) for i in range(20)]
    got = P.pack(spark.createDataFrame(rows, names)).collect()
    assert set(got[0].asDict()) == set(names) and sorted(r.salt for r in got) == list(range(20))
    check_places(got, P.CAPACITY)


def test_query_matches_sequential_packing(spark, tiny):
    """Every document whole, ids by the tokenizers library, and as few sequences as a plain first-fit by length, or fewer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = P.op1_best_fit_packing(spark, tiny).collect()
    pieces, expected = [], set()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or min(len(ids), 2048)
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces.append(b - a)
            expected.add((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    bins: list[int] = []
    for n in sorted(pieces, reverse=True):
        at = next((i for i, used in enumerate(bins) if used + n <= 2048), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert math.ceil(sum(pieces) / 2048) <= check_places(got, 2048) <= len(bins)
