import zlib

import numpy as np
from samples import prose
from sparkloom.llm import quality as Q


def corpus(n=400):
    """Prose, and shouting or stuttering text, labelled, with some rows unlabelled."""
    rows, labels = [], []
    for i in range(n):
        text = prose(60 + i % 40, 300 + i)
        bad = i % 4 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if i % 8 else " ".join(w for w in text.split()[:6] for _ in range(12))
        rows.append((i, text, "src", i % 3))
        if i % 7:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(1000, None, "s", 0), (1001, "", "s", 0), (1001, "", "s", 0), (None, prose(30, 1), "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = Q.quality_scores(docs, spark.createDataFrame(labels + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in by_id.items() if d is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by_id[1000].score == by_id[1001].score == 0
    held = [(by_id[d].predicted, q) for d, q, _ in labels if by_id[d].held_out]
    assert len(held) > 30 and np.mean([p == q for p, q in held]) > 0.95


def test_learns_nothing_from_held_out_rows(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(2)
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, 0) for d, q, _ in labels]
    one, two = ({r.doc_id: r.score for r in Q.quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, turned))
    assert one == two


def test_vote_is_exact():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors, queries = unit(rng.normal(size=(50, 8))), unit(rng.normal(size=(20, 8)))
    labels = rng.integers(0, 2, 50).astype(float)
    got = Q.Model(np.zeros(1), np.zeros((1, 8)), vectors, labels).vote(queries)
    for q, s in zip(queries, got):
        near = sorted(((max(q @ v, 0), y) for v, y in zip(vectors, labels)), reverse=True)[: Q.NEIGHBOURS]
        assert abs(s - sum(c**4 * y for c, y in near) / sum(c**4 for c, _ in near)) < 1e-9


def test_filter_keeps_columns_and_empty_tables(spark, empty):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = Q.keep_good(docs, table)
    assert kept.columns == docs.columns and 60 < kept.count() < 120
    assert Q.quality_scores(empty, table).collect() == []
    assert {r.score for r in Q.quality_scores(docs, table.limit(0)).collect()} == {0.0}


def test_columns_of_any_name_pass(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame([(*r[:2], 0.5, 1, "x") for r in rows], ["doc_id", "text", "_quality_score", "quality", "a.b"])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = Q.keep_good(docs, table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in Q.keep_good(plain, table).collect()}


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(d, f"{t} {k}") for d in range(1, 9) for k, t in enumerate("abc")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(1, 9)], "doc_id long, quality int, toxic int")
    got = Q.labelled_sample(docs, labels, 2)
    assert len(got) == len({r.doc_id for r in got}) <= 4 and {r.text for r in got} == {"a 0"}


def test_long_texts_and_ties(spark):
    rows, labels = corpus(120)
    docs = [(5000, prose(150_000, 9), "s", 0), (5001, rows[1][1], "s", 0), (5002, rows[1][1], "s", 0)]
    got = {r.doc_id: r.score for r in Q.quality_scores(spark.createDataFrame(rows + docs, "doc_id long, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[5000] > 0.5 and got[5001] == got[5002] == got[1]


def scores_by_definition(rows, labels):
    """The whole score in plain loops over dense vectors: counts, weights, decomposition, cosines and votes."""
    from collections import Counter

    cache = Q.WordBuckets()

    def bag(text):
        words = (text or "").encode().split()
        half, out = Q.BUCKETS // 2, Counter()
        for a, w in enumerate(words):
            out[cache[w] // half] += 1
            out[cache[w] % half + half] += 1
            if a and cache[w] == cache[words[a - 1]]:
                out[Q.AGAIN] += 1
        return out

    bags = {d: bag(t) for d, t in rows}
    df = Counter(b for x in bags.values() for b in x)

    def vector(x):
        v = np.zeros(Q.BUCKETS)
        for b, n in x.items():
            v[b] = np.log1p(n) * np.log((1 + len(bags)) / (1 + df[b]))
        for part, share in ((slice(0, Q.BUCKETS // 2), Q.WORD_SHARE), (slice(Q.BUCKETS // 2, None), 1 - Q.WORD_SHARE)):
            v[part] *= share / max(np.linalg.norm(v[part]), 1e-12)
        return v

    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    known = sorted((d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5)
    x = unit(np.array([vector(bags[d]) for d, _ in known]))
    _, s, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: Q.RANK][s[: Q.RANK] ** 2 > 1e-9]
    latent = unit(np.array([vector(bags[d]) for d, _ in known]) @ axes.T)
    out = {}
    for d in bags:
        cosines = np.maximum(latent @ unit(vector(bags[d]) @ axes.T), 0)
        near = np.argsort(-cosines)[: Q.NEIGHBOURS]
        w = cosines[near] ** Q.SHARPNESS
        out[d] = sum(w * np.array([known[i][1] for i in near])) / max(w.sum(), 1e-12)
    return out


def test_query_matches_its_definition(spark):
    rows, labels = corpus(150)
    rows = [r[:2] for r in rows] + [(900, None), (901, "word")]
    got = {r.doc_id: r.score for r in Q.quality_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    expected = scores_by_definition(rows, labels)
    # Single precision may swap neighbours that are equally near.
    assert got.keys() == expected.keys() and np.mean([abs(got[d] - expected[d]) < 0.02 for d in got]) > 0.95
    assert all((got[d] >= 0.3) == (expected[d] >= 0.3) for d in got if abs(expected[d] - 0.3) > 0.1)


def test_columns_named_like_labels(spark):
    """What documents call quality, toxic or predicted is neither read nor lost."""
    rows, labels = corpus(120)
    named = spark.createDataFrame([(d, t, 1, 0, "p", 0.1) for d, t, _, _ in rows], "doc_id long, text string, quality int, toxic int, predicted string, score double")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = {r.doc_id: r.score for r in Q.quality_scores(named.select("doc_id", "text"), labelled).collect()}
    assert {r.doc_id: r.score for r in Q.quality_scores(named, labelled).collect()} == plain
    kept = Q.keep_good(named, labelled)
    assert kept.columns == named.columns and {r.doc_id for r in kept.collect()} == {d for d, x in plain.items() if x >= Q.KEEP_FROM}


def test_the_driver_fits_nothing(spark, monkeypatch):
    """The matrix of the labelled rows and its decomposition are a task's; the model is that of the rows."""
    rows, labels = corpus(200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = Q.labelled_sample(docs, table)
    want = Q.fit([r.text.encode() for r in sample], [r.quality for r in sample], *Q.document_frequencies(docs))

    def refuse(*_):
        raise AssertionError("the driver decomposes")

    monkeypatch.setattr(np.linalg, "eigh", refuse)
    got = Q.train(docs, table)
    assert np.array_equal(got.labels, want.labels) and np.allclose(got.vectors @ got.vectors.T, want.vectors @ want.vectors.T, atol=1e-4)
