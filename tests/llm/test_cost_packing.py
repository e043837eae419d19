import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import cost_packing as C

histograms = st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25)


def spread(rows):
    """(size, number, start, length, sequence, offset) of every piece of a plan."""
    return [(size, first + k, start, length, sequence + k, offset) for size, first, n, start, length, sequence, offset in rows for k in range(n)]


def check_full(pieces, capacity):
    """Pieces (sequence, offset, length) lie without gaps; all sequences are full or a power of two. Their number."""
    by_sequence = defaultdict(list)
    for sequence, offset, length in pieces:
        by_sequence[sequence].append((offset, length))
    total, short = 0, 0
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
        total, short = total + at, short + (at < capacity)
    assert short == bin(total % capacity).count("1")
    return len(by_sequence)


@settings(max_examples=200, deadline=None)
@given(histograms)
def test_plan_places_every_token_once(histogram):
    rows = C.plan(histogram, 64)
    pieces = spread(rows)
    covered = Counter((size, number, at) for size, number, start, length, _, _ in pieces for at in range(start, start + length))
    assert covered == Counter((size, number, at) for size, n in histogram.items() for number in range(n) for at in range(size))
    check_full([p[4:] + (p[3],) for p in pieces], 64)
    places = C.Places(rows)
    assert {(size, k, start, length, k + shift, offset) for size, n in histogram.items() for k in range(n) for start, length, shift, offset in places.of(size, k)} == set(pieces)


def test_items_go_to_the_cheapest_sequence_with_room():
    """One item after another, as the method says, gives the same costs as the plan for many at a time."""
    histogram = {2048: 3, 1500: 7, 900: 20, 333: 31, 100: 60, 7: 90}
    total = sum(s * n for s, n in histogram.items())
    rooms = [2048] * (total // 2048) + [1 << b for b in range(11) if total % 2048 >> b & 1]
    spent = [0] * len(rooms)
    items = sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True)
    while items:
        size = items.pop(0)
        fits = [i for i, room in enumerate(rooms) if room >= size]
        at = min(fits, key=lambda i: (spent[i], i)) if fits else max(range(len(rooms)), key=lambda i: (rooms[i], -spent[i]))
        piece = min(size, rooms[at])
        rooms[at] -= piece
        spent[at] += C.cost(piece)
        if size > piece:
            items = sorted([*items, size - piece], reverse=True)
    planned: Counter = Counter()
    for p in spread(C.plan(histogram)):
        planned[p[4]] += C.cost(p[3])
    # Ties between sequences alike may fall otherwise.
    assert abs(np.std(list(planned.values())) / np.std(spent) - 1) < 0.05 and sum(rooms) == 0


def test_plan_grows_with_the_lengths_only():
    few, many = ({k: n * (1 + 5000 // k) for k in range(1, 2049)} for n in (1, 10**7))
    assert len(C.plan(few)) < 40_000 and len(C.plan(many)) < 40_000


def test_ids_are_the_tokenizers():
    words = C.WordIds(C.default_tokenizer())
    texts = [
        "", "It's  WE'LL don't 'S x's 12 1a2b3 ...!? ,a, ", "<|endoftext|>a <|startoftext|> b<|endoftext|>", "Éé ß µ ª º ² ½ ÷ ×", "á é é ́x", "ΑΣ ΣΑ İı ſ K",
        "中文 字 한글 하 ﬁ", "a\x85b\xa0c　d e", "\x1c x\x1dy \x00 \xad", "naïve—dash “quotes” it’s", "\n\t\x0b\x0c\r x \r\n y", "x" * 5000,
    ]
    for text in texts:
        assert np.frombuffer(words.of(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.characters(max_codepoint=0x2FF) | st.sampled_from("' s t re ve m ll d <|endoftext|> é ́ 中 ’".split(" ")), max_size=40))
def test_ids_of_any_text(letters):
    text = "".join(letters)
    words = C.word_ids(C.default_tokenizer())
    assert np.frombuffer(words.of(text), words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def check_packed(got, docs):
    """Every document's tokens once, in pieces whose ids are the library's."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(C.default_tokenizer())
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    expected = defaultdict(list)
    for doc_id, text in docs:
        expected[doc_id].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    assert set(by_doc) == set(expected)
    for doc_id, many in expected.items():
        pieces = by_doc[doc_id]
        assert sum(r.length for r in pieces) == sum(len(ids) for ids in many)
        for r in pieces:
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in many)
        if len(many) == 1:
            ends = sorted((r.start, r.start + r.length) for r in pieces)
            assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[-1][1] == len(many[0])
    check_full([(r.sequence_id, r.offset, r.length) for r in got], C.CAPACITY)


def test_rows_of_all_kinds(docs, rows, empty, monkeypatch):
    import pyspark.sql.functions as F

    monkeypatch.setattr(C, "ROWS_PER_SALT", 2)
    got = C.pack_balanced(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed(got, rows)
    nulls = docs.selectExpr("CAST(NULL AS long) AS doc_id", "text", "doc_id AS sequence_id", "1 AS number", "2 AS offset")
    check_packed(C.pack_balanced(nulls).withColumn("ids_crc32", F.crc32("ids")).collect(), [(None, t) for _, t in rows])
    assert C.pack_balanced(empty).collect() == []


def test_query_by_brute_force(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    check_packed(C.op12_cost_balanced_packing(spark, tiny).collect(), docs)
