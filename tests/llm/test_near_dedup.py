import numpy as np

from sparkloom.llm import near_dedup as N
from samples import prose


def edited(text, every, offset=0):
    return " ".join("edit" if i % every == offset else w for i, w in enumerate(text.split()))


def family():
    base, other = prose(300, 71), prose(300, 72)
    rows = [(1, base), (2, base.upper() + "!"), (3, edited(base, 100)), (4, edited(base, 99, 5)), (5, other), (6, edited(other, 6)), (7, None), (8, ""), (9, "..."), (10, "two words"), (11, "Two, words"), (12, prose(300, 73))]
    return rows + [(100 + k, edited(prose(200, 80), 150, k)) for k in range(40)] + [(13, prose(300, 73))]


def test_matches_aligning_all_pairs(spark):
    rows = family()
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, key string, label int").repartition(3)
    got = {r.doc_id: r for r in N.near_classes(docs).collect()}
    expected = N.brute_force(rows)
    assert {d: r.class_id for d, r in got.items()} == expected
    assert got[3].class_id == 1 and got[6].class_id == 6 and got[9].class_id == 9 and got[11].class_id == 10
    assert got[100].class_size == 40 and got[7].class_size == 1
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == sorted(d for d, c in expected.items() if d == c)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE_BUCKET", 3)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_classes(docs).collect()} == N.brute_force(rows)


def test_repeated_rows_null_ids_empty_table(spark, empty):
    text = prose(50, 74)
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in N.near_classes(docs).collect())
    assert got == [(0, 0, 1), (1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert N.near_classes(empty).collect() == []


def test_order_matters():
    a = [prose(40, 75 + k) for k in range(4)]
    cache = N.WordHashes()
    one, two = (N.labelled_runs(" ".join(x), cache) for x in (a, a[::-1]))
    shared = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert shared > 0.75 and N.similarity(one, two) < 0.5


def test_runs_are_distinct():
    runs = N.labelled_runs("a b c d e " * 30, N.WordHashes())
    assert len(np.unique(runs)) == len(runs) == 146


def test_similarity_is_the_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.permutation(60)[:50].astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 5)):
            i, j = rng.integers(0, 50, 2)
            b[i], b[j] = b[j], b[i]
        d = np.zeros((51, 51), int)
        for i in range(50):
            for j in range(50):
                d[i + 1, j + 1] = d[i, j] + 1 if a[i] == b[j] else max(d[i, j + 1], d[i + 1, j])
        exact = d[50, 50] / (100 - d[50, 50])
        assert (N.similarity(a, b) >= 0.8) == (exact >= 0.8)


def test_pairs_whose_sketches_agree_little_are_aligned(spark):
    words = prose(60, 4237).split()
    other = ["edit" if i in (12, 59) else w for i, w in enumerate(words)]
    # Near copies of a third text that are in the only band of the two; the hub is one of them.
    rows = [(q, " ".join([*words[30:39], *(f"z0x{n}" for n in range(4)), *words[48:53], *(f"z0x{n}" for n in range(4, 10)), f"end{q}"])) for q in range(6)]
    rows += [(20, " ".join(words)), (21, " ".join(other))]
    cache = N.WordHashes()
    a, b = (N.order_sketches(N.labelled_runs(t, cache)) for _, t in rows[-2:])
    assert np.count_nonzero(a == b) == 10 and np.count_nonzero((a == b)[::2] & (a == b)[1::2]) == 1
    got = {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == N.brute_force(rows) and got[21] == 20


def test_groups_give_links_by_member_not_by_pair():
    cache = N.WordHashes()
    runs = [N.labelled_runs(edited(prose(200, 80), 150, k), cache) for k in range(60)] + [N.labelled_runs(prose(200, 81), cache)]
    rep = np.arange(61)
    assert len(N.links_of(rep, rep, np.ones(61, int), True, runs)) == 59
    assert len(N.links_of(rep, rep, (rep < 40).astype(int), False, runs)) == 59
    assert N.links_of(rep, rep // 60, np.ones(61, int), True, runs) == []


def test_blocks_let_every_pair_meet_once(spark, monkeypatch):
    monkeypatch.setattr(N, "LARGE_BUCKET", 4)
    free = [(5, r, r, False, 9, 11) for r in range(11)]
    main = [(5, r, 99, True, 9, 11) for r in range(11, 20)]
    rows = N.in_blocks(spark.createDataFrame(free + main, "band long, rep long, label long, main boolean, n_main long, n_free long")).collect()
    met = []
    for i, j in {(r.i, r.j) for r in rows}:
        group = [r for r in rows if (r.i, r.j) == (i, j)]
        assert len(group) == len({r.rep for r in group}) and len({r.within for r in group}) == 1
        for x in group:
            met += [tuple(sorted((x.rep, y.rep))) for y in group if x.side == 1 and (y.side == 0 or x.within and y.rep < x.rep)]
    assert sorted(met) == sorted((a, b) for a in range(11) for b in range(a + 1, 20))


def by_definition(rows):
    """Classes by words alone: labelled five-word runs, their longest common subsequence in a table, all pairs."""
    import re
    from collections import Counter

    def runs(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        k, seen, out = min(5, len(words)), Counter(), []
        for i in range(len(words) - k + 1 if words else 0):
            run = tuple(words[i : i + k])
            out.append((run, seen[run]))
            seen[run] += 1
        return out

    def common(a, b):
        row = np.zeros(len(b) + 1, int)
        for x in a:
            match = np.array([x == y for y in b])
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(match, row[:-1] + 1, 0)))
        return row[-1]

    texts = [(d, runs(t)) for d, t in sorted(rows)]
    classes = {d: d for d, _ in texts}
    for i, (d, x) in enumerate(texts):
        for e, y in texts[:i]:
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                n = common(x, y)
                if n >= 0.8 * (len(x) + len(y) - n) and classes[d] != classes[e]:
                    low, high = sorted((classes[d], classes[e]))
                    classes = {k: low if c == high else c for k, c in classes.items()}
    return classes


def test_matches_the_definition(spark):
    rows = [(d, " ".join((t or "").split()[:120])) for d, t in family() if d < 110] + [(200, "a b c d"), (201, "A b, c d!"), (202, "a b c"), (203, None)]
    assert {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == by_definition(rows)


def test_recall_on_a_table(spark):
    """Links that aligning all pairs finds and the bands don't."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in N.op6_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    expected = N.brute_force(rows)
    linked = [d for d, c in expected.items() if d != c]
    recall = sum(got[d] == expected[d] for d in linked) / len(linked)
    print(f"recall {recall:.4f} of {len(linked)}")
    assert recall >= 0.99 and all(got[d] == d for d, c in expected.items() if got[d] == d)


def test_a_large_cluster_with_a_shared_line(spark):
    line = prose(45, 91)
    rows = [(i, edited(prose(150, 92), 140, i % 140)) for i in range(150)]
    rows += [(1000 + i, f"{line} {prose(60, 2000 + i)}") for i in range(120)]
    rows += [(2000 + i, f"{prose(200, 93)} {prose(12 + i % 7, 3000 + i // 7)}") for i in range(70)]
    got = {r.doc_id: r.class_id for r in N.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == N.brute_force(rows)


def test_long_texts_ties_and_columns_of_any_name(spark):
    long = prose(60_000, 94)
    rows = [(5, long, 1), (3, edited(long, 20_000), 2), (4, "same words here", 3), (2, "Same words, here", 4), (2, "Same words, here", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id int")
    assert {r.doc_id: r.class_id for r in N.near_classes(docs).collect()} == {5: 3, 3: 3, 4: 2, 2: 2}
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r["_gone_id"]) for r in kept.collect()) == [(2, 4), (2, 5), (3, 2)]
