import uuid

import pytest
from sparkloom.llm import token_counts as C


@pytest.fixture
def rollup(spark):
    return C.Rollup(spark, f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}")


CHANGES = [
    ("insert", "a", "en", "v", None, 5),
    ("insert", "a", None, "v", None, 7),
    ("insert", "b", "en", "v", None, None),
    ("delete", "a", "en", "v", 5, None),
    ("insert", "a", "en", "v", None, 4),
    ("revise", "a", "en", "v", 4, 9),
    ("other", "a", "en", "v", 4, 9),
]


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_signed_sums_and_idempotent_commits(spark, rollup):
    assert totals(rollup) == {}
    changes = spark.createDataFrame(CHANGES, C.CHANGES)
    expected = {("a", "en", "v"): (1, 9), ("a", None, "v"): (1, 7), ("b", "en", "v"): (1, 0)}
    for _ in range(2):
        rollup.commit("batch-1", C.delta(changes))
        assert totals(rollup) == expected
    rollup.commit("batch-2", C.delta(spark.createDataFrame([("delete", "a", "en", "v", 9, None)], C.CHANGES)))
    assert totals(rollup) == {k: v for k, v in expected.items() if k != ("a", "en", "v")}
    # A batch that was wrong is sent anew under its id.
    rollup.commit("batch-2", C.delta(spark.createDataFrame([], C.CHANGES)))
    assert totals(rollup) == expected
    rollup.vacuum()
    assert totals(rollup) == expected and rollup.manifest()[0] == 4


def test_commits_are_whole(spark, rollup):
    one, two = (C.delta(spark.createDataFrame([("insert", "a", "en", "v", None, n)], C.CHANGES)) for n in (5, 7))
    rollup.commit("1", one)
    # A commit that ends between its sums and its manifest changes nothing.
    two.selectExpr("'2' AS batch_id", *C.KEYS, "documents", "tokens").write.parquet(f"{rollup.path}/sums/stray")
    before = rollup.batches()
    assert totals(rollup) == {("a", "en", "v"): (1, 5)}
    # Another one gets its manifest in first.
    other, publish = C.Rollup(spark, rollup.path), rollup._publish
    late = iter([lambda *a: (other.commit("3", two), publish(*a))[1], publish])
    rollup._publish = lambda *a: next(late)(*a)
    rollup.commit("../2 ü", two)
    assert totals(rollup) == totals(other) == {("a", "en", "v"): (3, 19)} and before.count() == 1
    assert not other._publish(1, {}) and other.manifest()[0] == 3
    rollup._publish = publish
    rollup.vacuum()
    assert totals(rollup) == {("a", "en", "v"): (3, 19)}


@pytest.mark.parametrize("most", [1, 2, 3])
def test_totals_are_kept_and_batches_folded(spark, rollup, monkeypatch, most):
    """Commits, resent and replaced batches before and after they were folded; the manifest stays small."""
    import random

    monkeypatch.setattr(C.Rollup, "MOST_RECENT", most)
    rng, latest = random.Random(most), {}
    for k in range(10):
        batch_id = f"b{rng.randrange(5)}"
        rows = [("insert", rng.choice("xy"), None, "v", None, rng.randint(1, 9)) for _ in range(rng.randint(0, 3))]
        rollup.commit(batch_id, C.delta(spark.createDataFrame(rows, C.CHANGES)))
        latest[batch_id] = rows
        state = rollup.manifest()[1]
        assert len(state["recent"]) < most and len(state["folded"]) <= 4
        expected: dict = {}
        for r in (r for rows in latest.values() for r in rows):
            n = expected.setdefault((r[1], None, "v"), [0, 0])
            n[0] += 1
            n[1] += r[5]
        if k % 2:
            assert totals(rollup) == {key: tuple(n) for key, n in expected.items()}
    assert {r.batch_id for r in rollup.batches().collect()} == {b for b, rows in latest.items() if rows}
    rollup.vacuum()
    assert totals(rollup) == {key: tuple(n) for key, n in expected.items()}


def test_counts_texts(spark, docs):
    changes = docs.selectExpr("'insert' AS op", "source", "'en' AS lang", "CAST(NULL AS string) AS old_text", "text AS new_text", "1 AS old_tokens")
    sums = {(r.source, r.version): (r.documents, r.tokens) for r in C.delta(C.counted(changes)).collect()}
    rows = docs.collect()
    for version in C.VERSIONS:
        for source in {r.source for r in rows}:
            own = [r for r in rows if r.source == source]
            assert sums[source, version] == (len(own), sum(C.count_tokens(r.text, version) for r in own))


def test_query_matches_brute_force(spark, tiny):
    from pyspark.sql import functions as F

    labels = {}
    for r in spark.read.parquet(f"{tiny}/labels.parquet").collect():
        labels[r.doc_id] = (r.toxic, r.quality)
    docs = spark.read.parquet(f"{tiny}/documents.parquet").withColumn("clean", C.redacted(F.col("text"))).collect()
    expected: dict = {}
    for d in docs:
        toxic, quality = labels.get(d.doc_id, (0, 1))
        if toxic == 1:
            continue
        text = d.clean if quality == 0 else d.text
        for version in C.VERSIONS:
            n = expected.setdefault((d.source, d.lang, version), [0, 0])
            n[0] += 1
            n[1] += C.count_tokens(text, version)
    got = {(r.source, r.lang, r.version): [r.documents, r.tokens] for r in C.op9_token_counts(spark, tiny).collect()}
    assert got == {k: v for k, v in expected.items() if any(v)}


def test_empty_tables(spark, empty):
    changes = empty.selectExpr("'insert' AS op", "source", "'en' AS lang", "text AS old_text", "text AS new_text")
    assert C.totals_of(spark, [("0", C.counted(changes))]).collect() == []
    assert C.totals_of(spark, []).collect() == []


def test_a_batch_sent_again_counts_once(spark, docs):
    changes = C.counted(docs.selectExpr("'insert' AS op", "source", "'en' AS lang", "CAST(NULL AS string) AS old_text", "text AS new_text"))
    once = sorted(map(str, C.totals_of(spark, [("0", changes)]).collect()))
    assert once == sorted(map(str, C.totals_of(spark, [("0", changes), ("0", changes)]).collect()))
    twice = C.totals_of(spark, [("0", changes), ("1", changes)]).collect()
    assert {(r.source, r.version): r.documents for r in twice} == {k: 2 * n for k, n in {(r.source, r.version): r.documents for r in C.totals_of(spark, [("0", changes)]).collect()}.items()}
