import hashlib
from collections import defaultdict

import numpy as np

from sparkloom.llm import exact_dedup as E


def lower(text):
    return (text or "").encode().lower()


def test_groups_match_brute_force(docs, rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    expected = sorted((d, max(groups[lower(t)]), len(groups[lower(t)]), d == max(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest()) for d, t in rows)
    got = E.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected
    assert {r.doc_id for r in got if r.route == "unique"} == {2, 6, 9, 10, 12}


def test_empty_table(empty):
    assert E.exact_groups(empty).collect() == []
    assert E.drop_exact(empty).columns == empty.columns


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b"), (3, "A")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_groups(docs).collect()}
    assert got == {(None, 3, 2, False), (None, None, 1, True), (3, 3, 2, True)}


def test_drop_keeps_columns_and_one_of_repeated_rows(docs):
    kept = E.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 8, 9, 10, 11, 12]


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    top = np.uint64(5) << np.uint64(64 - E.SLICE_BITS)
    prints = np.concatenate([top | (x >> np.uint64(E.SLICE_BITS)) for x in [rng.integers(0, 1 << 63, 400, dtype=np.uint64)] * 2 + [rng.integers(0, 1 << 63, 300, dtype=np.uint64)]])
    blobs = [E.encode_filter(*np.unique(part, return_counts=True)) for part in np.array_split(prints, 7)]
    keys, counts = E.merge_filters(blobs)
    expected, n = np.unique(prints & np.uint64((1 << (64 - E.SLICE_BITS)) - 1), return_counts=True)
    assert np.array_equal(keys, expected) and np.array_equal(counts, n)


def test_drop_decides_null_and_repeated_ids_by_their_texts(spark):
    rows = [(None, "a"), (None, "b"), (3, "A"), (4, "c"), (4, "d"), (4, "c"), (5, "D"), (None, "e"), (None, "e")]
    kept = E.drop_exact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0), r.text) for r in kept.collect()) == [(0, "b"), (0, "e"), (3, "A"), (4, "c"), (5, "D")]


def test_columns_of_any_name_pass(spark):
    names = ["doc_id", "text", "_n", "_keep_id", "_KEEP_SHA", "__n", "group_size", "a.b"]
    rows = [(1, "a", 5, 6, 7, 8, 9, 10), (2, "A", 5, 6, 7, 8, 9, 10), (2, "A", 5, 6, 7, 8, 9, 11)]
    docs = spark.createDataFrame(rows, names)
    kept = E.drop_exact(docs)
    assert kept.columns == names and [tuple(r)[:7] for r in kept.collect()] == [rows[1][:7]]
