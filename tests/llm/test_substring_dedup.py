import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from samples import prose
from sparkloom.llm import substring_dedup as S


def test_matches_brute_force(docs, rows):
    from pyspark.sql import functions as F

    expected = S.brute_force(rows)
    got = S.remove_repeats(docs).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert len(got) == len(rows)
    assert all((r.n_words, r.n_removed, r.sha) == expected[r.doc_id] for r in got)
    assert any(r.n_removed and r.n_removed < r.n_words for r in got)


def test_repeats_within_a_document_stay(spark):
    docs = spark.createDataFrame([(1, " ".join("abcdefghijklmnop") + " " + " ".join("abcdefghijklmnop"))], "doc_id long, text string")
    assert S.remove_repeats(docs).first().n_removed == 0


def test_empty_table_and_null_id(spark, empty):
    assert S.remove_repeats(empty).collect() == []
    text = " ".join(map(str, range(20)))
    got = S.remove_repeats(spark.createDataFrame([(None, text), (2, text)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0, 0]


@given(st.lists(st.integers(0, 60), max_size=20), st.integers(1, 9))
def test_intervals_cover_the_windows(starts, window):
    covered = {j for s in starts for j in range(s, s + window)}
    merged = S.merge_intervals(np.array(starts, np.int64), window)
    assert covered == {j for a, b in merged for j in range(a, b)}
    assert all(b < c for (_, b), (c, _) in zip(merged, merged[1:]))


@settings(max_examples=50)
@given(st.lists(st.lists(st.integers(0, 10**6), min_size=1, max_size=8, unique=True), min_size=1, max_size=5))
def test_starts_round_trip(docs):
    starts = np.concatenate([np.sort(d) for d in docs]).astype(np.int32)
    counts = np.array([len(d) for d in docs])
    at = np.cumsum(counts) - counts
    assert np.array_equal(S.unpack_starts(S.pack_starts(starts, at), counts), starts)


def test_flushes_in_parts(monkeypatch, docs, rows):
    """Several flushes of a task give the same result: held windows are only a memory bound."""
    import pyarrow as pa

    monkeypatch.setattr(S, "HELD_WINDOWS", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": pa.array([t for _, t in rows], pa.string())})
    sent = [b.to_pandas() for b in S._send(8, S.WINDOW)(iter([batch]))]
    import pandas as pd

    whole = pd.concat(sent)
    found: dict = {}
    for _, group in whole.groupby("bucket"):
        for d, starts in S._count(7)(group).itertuples(index=False):
            found.setdefault(int(d), set()).update(int(s) for s in starts)
    removed = {d: sum(b - a for a, b in S.merge_intervals(np.array(sorted(s)))) for d, s in found.items()}
    assert removed == {d: n for d, (_, n, _) in S.brute_force(rows).items() if n}


def test_a_hot_window_and_long_texts(spark):
    """A passage that many documents share, and texts of many windows."""
    passage = prose(20, 70)
    rows = [(i, f"{prose(15, 700 + i)} {passage} {prose(15, 900 + i)}") for i in range(300)] + [(1000, prose(30_000, 71)), (1001, prose(30_000, 71) + " end")]
    got = S.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, repeated int").repartition(6)).collect()
    expected = S.brute_force(rows)
    assert all((r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) == expected[r.doc_id] for r in got)


def test_memory_of_a_task_is_bounded():
    """Two million windows go on in parts, and a batch's kept texts come in blocks."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(map(str, range(k, k + 100_000))) for k in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": texts})
    tracemalloc.start()
    sent = sum(b.num_rows for b in S._send(8, S.WINDOW)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sent and peak < 150e6
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": ["a b"] * 1200, "repeated": pa.array([None] * 1200, pa.list_(pa.int32()))})
    done = list(S._remove(S.WINDOW)(iter([rows])))
    assert max(b.num_rows for b in done) <= 500 and sum(b.num_rows for b in done) == 1200
