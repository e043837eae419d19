from sparkloom.llm import decontamination as D
from samples import prose

ITEMS = [(0, "What is it? " + prose(20, 51)), (1, prose(30, 52)), (2, None), (3, "?!"), (4, prose(50, 53) + ". " + prose(6, 54)), (None, "some words"), (1, prose(30, 52))]
TEXTS = [
    (1, prose(200, 61)),
    (2, prose(90, 62) + " " + prose(30, 52).upper() + " " + prose(90, 63)),
    (3, "What is it? " + prose(20, 51)),
    (4, None),
    (5, ""),
    (6, prose(40, 64) + " " + prose(50, 53)),
    (7, prose(500, 65) + "\n" + prose(50, 53) + ". " + prose(6, 54)),
    (7, prose(500, 65) + "\n" + prose(50, 53) + ". " + prose(6, 54)),
]


def test_finds_whole_items_only(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id long, text string, item_id string, score int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2, 1), (3, 0), (7, 4), (7, 4)]
    assert sorted(r.doc_id for r in D.drop_leaks(docs, bench).collect()) == [1, 4, 5, 6]


def test_matches_scoring_of_all_pairs():
    texts = TEXTS + [(100 + k, prose(60 + 7 * k, k % 9 + 51) + " " + prose(30, 52 + k % 3)) for k in range(40)]
    index = D.Index.build(ITEMS)
    gate = D.Gate(index)
    got = {(d, hit[0]) for d, t in texts for hit in D.find_in_text(t, index, gate)}
    assert got == D.brute_force(texts, ITEMS) and len(got) > 5


def test_block_max_wand_finds_all_above_threshold():
    items = [(i, prose(25, 200 + i % 17) + f" only{i} also{i}") for i in range(60)]
    index = D.Index.build(items)
    for k in range(30):
        words = set(D.words_of(prose(60, 200 + k) + f" only{k} also{k}"))
        terms = sorted(index.terms[w] for w in words if w in index.terms)
        for threshold in (0.2, 0.5, 0.8):
            scores = {}
            for t in terms:
                for d, w in zip(index.docs[t], index.weights[t]):
                    scores[d] = scores.get(d, 0.0) + w
            assert {d for d, _ in index.search(terms, threshold)} == {d for d, s in scores.items() if s >= threshold - 1e-9}


def test_every_word_lies_in_a_passage():
    for n in (0, 1, 31, 32, 64, 65, 97, 1000):
        bounds = D.passage_bounds(n, 32)
        assert bounds[0][0] == 0 and bounds[-1][1] == n
        assert all(b[0] - a[0] == 32 and a[1] - a[0] == 64 for a, b in zip(bounds, bounds[1:]))


def test_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.find_leaks(empty, bench).collect() == []
    assert D.find_leaks(docs, bench.limit(0)).collect() == []


def test_drop_decides_null_and_repeated_ids_by_their_texts(spark):
    rows = [(None, TEXTS[1][1]), (None, TEXTS[0][1]), (None, None), (9, TEXTS[2][1]), (9, TEXTS[5][1])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.drop_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {rows[1], rows[2], rows[4]}


def test_parts_of_a_benchmark_give_what_the_whole_gives(spark, monkeypatch):
    items = ITEMS + [(10 + k, prose(25, 300 + k) + f" only{k % 5}") for k in range(30)]
    texts = TEXTS + [(200 + k, " ".join(prose(25, 300 + k).split()[: 13 + k % 12]) + f" only{k % 5} " + prose(60, 400 + k)) for k in range(30)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    assert {r[:2] for r in whole} == D.brute_force(texts, items)
    monkeypatch.setattr(D, "INDEX_ITEMS", 12)
    parts = sorted(map(tuple, D.find_leaks(docs, bench).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in whole] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(parts, whole))


def test_repeated_rows_of_a_text_with_two_items(spark):
    one, two = prose(25, 71), prose(25, 72)
    text = " ".join([prose(30, 1), one, prose(300, 2), two])
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    found = D.find_leaks(docs, spark.createDataFrame([(5, one), (6, two), (6, two)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 5), (0, 6), (1, 5), (1, 5), (1, 6), (1, 6)]


def test_one_index_is_broadcast_at_a_time(spark, monkeypatch):
    """Fifty parts, and never two indexes with the executors."""
    monkeypatch.setattr(D, "INDEX_ITEMS", 1)
    items = [(k, prose(25, 300 + k)) for k in range(50)]
    texts = [(k, prose(9, k) + " " + prose(25, 300 + k)) for k in range(0, 50, 7)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    live, most, made = set(), [0], type(spark.sparkContext).broadcast

    def broadcast(context, value):
        b = made(context, value)
        live.add(b)
        most[0] = max(most[0], len(live))
        end = b.destroy
        b.destroy = lambda *a: (live.discard(b), end(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    found = D.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert most[0] == 1 and not live
    assert {(r.doc_id, r.item_id) for r in found.collect()} == D.brute_force(texts, items)


def test_columns_of_any_name_pass(spark):
    docs = spark.createDataFrame([(d, t, 1, "x", 2.0, 3) for d, t in TEXTS], "doc_id long, text string, _leak_id int, _leak_sha string, score double, text_sha256 int")
    kept = D.drop_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_long_texts_and_ties(spark):
    item = prose(30, 52)
    long = " ".join([prose(40_000, 81), item, prose(40_000, 82), item, prose(500, 83)])
    bench = spark.createDataFrame([(1, item), (2, item), (3, item + " end")], "item_id long, text string")
    got = D.find_leaks(spark.createDataFrame([(1, long)], "doc_id long, text string"), bench).collect()
    assert [r.item_id for r in sorted(got)] == [1, 2, 3] and len({r.passage_start for r in got}) == 1
    # Of equal places the first one counts.
    assert got[0].passage_start <= 40_000


def test_words_bound_an_index_too(spark, monkeypatch):
    monkeypatch.setattr(D, "INDEX_WORDS", 40)
    built, parts = D.indexes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert parts > 2 and built.count() <= parts


def brute_by_words(docs, items):
    """(doc_id, item_id) without any of the index's code: weights, passages and overlaps from their definitions."""
    import math
    import re

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = sorted({(i, t) for i, t in items if i is not None and words(t)})
    bags = [words(t) for _, t in items]
    df = {w: sum(w in b for b in bags) for b in bags for w in b}
    mean, stride = sum(map(len, bags)) / len(bags), max(32, max(map(len, bags)))
    weigh = lambda w, b: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean))
    runs = lambda ws: {tuple(ws[i : i + 3]) for i in range(len(ws) - 2)}

    def sides(t):
        t = t.strip().rstrip(".? \n")
        for mark in "?", "\n", ". ":
            at = t.rfind(mark)
            if at >= 0 and len(words(t[:at])) >= 3 and words(t[at:]):
                return words(t[:at]), words(t[at:])
        ws = words(t)
        return ws[: (len(ws) + 1) // 2], ws[(len(ws) + 1) // 2 :]

    found = set()
    for d, t in docs:
        ws = words(t)
        last = max(0, math.ceil((len(ws) - stride) / stride) - 1)
        for k in range(last + 1):
            p = ws[k * stride : len(ws) if k == last else (k + 2) * stride]
            for (i, text), b in zip(items, bags):
                score = sum(weigh(w, b) for w in set(b) & set(p)) / sum(weigh(w, b) for w in set(b))
                share = lambda s: 1.0 if not s else (float(set(s) <= set(p)) if len(s) < 3 else len(runs(s) & runs(p)) / len(runs(s)))  # noqa: E731, B023
                if score >= 0.5 - 1e-9 and all(share(s) >= 0.5 for s in sides(text)):
                    found.add((d, i))
    return found


def test_matches_the_definitions(spark):
    texts = TEXTS + [(100 + k, prose(60 + 7 * k, k % 9 + 51) + " " + prose(30, 52 + k % 3)) for k in range(25)]
    items = ITEMS + [(20 + k, prose(12 + k, 51 + k % 4) + "? " + prose(2, 90 + k)) for k in range(8)]
    got = D.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_by_words(texts, items)
