import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import similarity
from sparkloom.operators import dedup, impute, outliers, profile, ranks, search, validate
from sparkloom.plans.names import name_score
from sparkloom.schemas import ColumnPlan, Impute, Outlier, TablePlan
from sparkloom.schemas import SemanticType as T


@pytest.fixture(scope="module")
def spiky(spark):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate([10, 11, 12, 13, 14, 15, 16, 17, 18, 500])] + [(10, None)], "i int, x double")


def column(df, c="x", order="i"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_outliers(spiky):
    treat = lambda how, k=1.5: outliers.treat_outliers(spiky, {"x": ColumnPlan(outlier=how, threshold=k)})
    assert column(treat(Outlier.CLIP_IQR))[-2:] == [23.5, None]
    assert column(treat(Outlier.SET_NULL))[-2:] == [None, None]
    assert column(treat(Outlier.DROP)) == [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, None]
    values = [10, 11, 12, 13, 14, 15, 16, 17, 18, 500]
    high = statistics.mean(values) + 1.5 * statistics.stdev(values)
    assert abs(column(treat(Outlier.CLIP_ZSCORE))[-2] - high) < 1e-6
    assert column(treat(Outlier.CLIP_ZSCORE, 0.5))[-2] == 500.0
    assert column(treat(Outlier.NONE)) == column(spiky)


def test_no_bounds_for_few_or_equal_values(spark, spiky):
    few = spiky.where("i < 9")
    assert outliers.outlier_bounds(few, {"x": ColumnPlan(outlier=Outlier.CLIP_IQR)}) == {}
    same = spark.createDataFrame([(1.0,)] * 20 + [(9.0,)], "x double")
    assert outliers.outlier_bounds(same, {"x": ColumnPlan(outlier=Outlier.CLIP_IQR)}) == {}


def test_dropping_columns_see_the_rows_left(spark):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(30)] + [(30, 900.0, 800.0)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    out = outliers.treat_outliers(df, {"x": ColumnPlan(outlier=Outlier.DROP), "y": ColumnPlan(outlier=Outlier.CLIP_IQR)})
    assert out.count() == 30 and out.agg(F.max("y")).first()[0] == 6.0


def filled(spark, rows, plan, order="i"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return column(impute.impute(df, TablePlan({"x": plan}), order))


def test_imputation(spark):
    assert filled(spark, ["1", None, "4"], ColumnPlan(T.NUMERIC_FLOAT, Impute.MEAN)) == ["1", "2.5", "4"]
    assert filled(spark, ["28", None, "29"], ColumnPlan(T.AGE)) == ["28", "28", "29"]
    assert filled(spark, ["29", None, "30"], ColumnPlan(T.AGE)) == ["29", "30", "30"]
    assert filled(spark, ["a", None], ColumnPlan(T.CURRENCY_AMOUNT)) == ["a", None]
    assert filled(spark, ["b", "a", None, "b", "a"], ColumnPlan(T.CITY)) == ["b", "a", "a", "b", "a"]
    assert filled(spark, [None, None], ColumnPlan(T.CITY)) == ["Unknown", "Unknown"]
    assert filled(spark, [None, "a", None, None, "b", None], ColumnPlan(T.DATE)) == ["a", "a", "a", "a", "b", "b"]
    assert filled(spark, [None, "a", None, None, "b", None], ColumnPlan(impute=Impute.BACKWARD_FILL)) == ["a", "a", "b", "b", "b", "b"]
    assert filled(spark, [None, "a"], ColumnPlan(T.EMAIL)) == ["Unknown", "a"]
    assert filled(spark, [None, "a"], ColumnPlan(impute=Impute.CONSTANT, constant="-")) == ["-", "a"]
    assert filled(spark, [None, "a"], ColumnPlan(impute=Impute.DROP_ROW)) == ["a"]
    assert filled(spark, [None, "a"], ColumnPlan(impute=Impute.NONE)) == [None, "a"]
    with pytest.raises(ValueError):
        filled(spark, [None, "a"], ColumnPlan(T.DATE), None)


def test_filling_is_the_same_for_any_partitioning(spark):
    rows = [(i, None if i % 7 or 100 < i < 300 else i) for i in range(500)]
    expected = None
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "i int, x int").repartition(parts)
        got = column(impute.fill_along(df, ["x"], "i"))
        last, want = None, []
        for _, x in rows:
            last = x if x is not None else last
            want.append(last)
        assert got == want and (expected is None or got == expected)
        expected = got


def test_filling_is_split_and_linear(spark, monkeypatch):
    """Ranges of a fixed number whatever their bytes, groups and ties over several of them, and no frame that looks ahead."""
    rows = [(g, 1 if g == 0 else i, None if i % 5 else i * 10 + (g or 0)) for g in (0, 1, None) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, i int, x int")
    written = []
    monkeypatch.setattr(impute, "cut", lambda t: written.append(t) or t.cache())
    got = impute.fill_along(df, ["x"], "i", ["g"], ranges=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing" not in plan.lower() and "rowframe, 1, unboundedfollowing" not in plan.lower()
    assert len({r["_range"] for r in written[0].select("_range").distinct().collect()}) >= 14
    filled_in = {}
    for r in got.collect():
        filled_in.setdefault(r.g, []).append((r.i, r.x))
    assert sorted(filled_in[1]) == [(i, i // 5 * 50 + 1) for i in range(400)]
    assert [i for i, _ in sorted(filled_in[None])] == list(range(400))
    assert all(x is not None for _, x in filled_in[0]) and len(filled_in[0]) == 400
    assert len(impute.fill_along(df, ["x"], "i", ranges=16).collect()) == 1200


def test_filling_keeps_rows_without_order(spark):
    rows = [(None, None), (None, "z"), (2, None), (1, "a"), (3, None)]
    df = spark.createDataFrame(rows, "i int, x string").repartition(3)
    got = impute.fill_along(df, ["x"], "i").collect()
    assert len(got) == 5 and {r.i: r.x for r in got if r.i} == {1: "a", 2: "a", 3: "a"} and all(r.x == "z" for r in got if r.i is None)
    got = impute.fill_along(spark.createDataFrame([(None, "z"), (1, None)], "i int, x string").repartition(2), ["x"], "i").collect()
    assert {r.i: r.x for r in got} == {None: "z", 1: "z"}


def test_quantiles_and_modes_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    columns = {"a": rng.normal(size=997).round(2), "b": rng.integers(0, 5, 997).astype(float), "c": np.full(997, 3.0)}
    rows = [tuple(None if i % 11 == k else float(v[i]) for k, v in enumerate(columns.values())) for i in range(997)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {r.col_name: r.q for r in ranks.quantiles(ranks.ranked(ranks.numbers_of(df, ["a", "b", "c"])), shares).collect()}
    for k, c in enumerate(columns):
        assert np.allclose(got[c], np.quantile([r[k] for r in rows if r[k] is not None], shares))
    words = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("x", 2), (None, 2)], "w string, n int")
    assert ranks.modes(words, ["w", "n"]) == {"w": "x", "n": "2"} and ranks.modes(words, []) == {}
    assert ranks.quantiles(ranks.ranked(ranks.numbers_of(df.limit(0), ["a"])), [0.5]).collect() == []


def similar_by_loop(texts, threshold):
    out = {}
    for i, x in texts:
        for j, y in texts:
            if i < j and x.strip() and y.strip() and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and name_score(x, y) >= threshold:
                out[i, j] = round(name_score(x, y), 9)
    return out


@pytest.mark.parametrize("threshold", [0.45, 0.6, 0.8, 0.85, 0.92])
def test_pairs_match_comparing_all(spark, threshold):
    import random

    rng = random.Random(int(threshold * 100))
    base = ["anna khan", "bilal ahmed", "ab", "a", "zzzzzzzz", "the quick brown fox jumps", " padded name ", "Ünïcode ñame"]
    names = [*base, "", "   ", None]
    for _ in range(120):
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "a", " ", "kh"])
        names.append("".join(x))
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    got = {(r.a, r.b): round(r.score, 9) for r in dedup.similar_pairs(df, ["x"], "i", threshold).collect()}
    # The library trims spaces, the loop all white space; the texts have no other.
    assert got == similar_by_loop([(i, x or "") for i, x in enumerate(names)], threshold)


def test_null_filters(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", None), (None, None, None)], "a int, b string, c string")
    assert impute.drop_null_columns(df).columns == ["a", "b"]
    assert impute.drop_null_rows(df).count() == 1


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1), (4, "b", 1)], "i int, x string, y int")
    assert sorted(r.i for r in dedup.drop_exact(df, "i").collect()) == [1, 2]
    assert sorted((r.i, r.x) for r in dedup.drop_exact(df, "i", ["x"]).collect()) == [(1, "a"), (2, "b")]
    assert dedup.drop_exact(df.drop("i")).count() == 2


def test_fuzzy_dedup_is_the_sequential_loop(spark):
    names = ["anna khan", "ana khan", "anna khann", "bilal", "bilal a", "bilaal", "zz", "zzz", "", None, "abcdefghij", "abcdefghix", "abcdefghxx", "abcdefgxxx"] * 2
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    texts = [(i, x or "") for i, x in enumerate(names)]
    gone: set = set()
    for i, x in texts:
        if i in gone or not x.strip():
            continue
        for j, y in texts[i + 1 :]:
            if j not in gone and y.strip() and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and name_score(x, y) >= 0.85:
                gone.add(j)
    assert {r.i for r in dedup.drop_similar(df, ["x"], "i").collect()} == set(range(len(names))) - gone


def test_validation(spark):
    df = spark.createDataFrame([("923001234567", "a@b.cd", "35201-1234567-1", "5", None), ("+923001234567", "x", "12", "121", None), (None, None, None, "x", None)], "p string, e string, c string, a string, n string")
    report = validate.validate(df, {"p": T.PHONE_PAKISTAN, "e": T.EMAIL, "c": T.CNIC_PAKISTAN, "a": T.AGE})
    got = {r.col_name: (r.valid_count, r.invalid_count, r.null_count, r.compliance_rate) for r in report.collect()}
    assert got == {"p": (2, 0, 1, 100.0), "e": (1, 1, 1, 50.0), "c": (1, 1, 1, 50.0), "a": (1, 2, 0, 33.33), "n": (0, 3, 3, 0.0)}
    assert not validate.passed(report) and validate.anomalies(report).count() == 3
    assert validate.passed(validate.validate(df.select("p"), {"p": T.PHONE_PAKISTAN}))


def test_search(spark):
    df = spark.createDataFrame([(1, "Ali Khan", "Lahore"), (2, "Sara", "Karachi"), (3, None, "khanewal")], "i int, name string, city string")
    hits = search.search(df, {"query": {"multi_match": {"query": "KHAN", "fields": ["name"]}}})
    assert sorted((r.i, r._score) for r in hits.collect()) == [(1, 1.0), (3, 1.0)]
    assert search.search(df, {"term": {"x": 1}}).count() == 3 and search.search(df).count() == 3
    with pytest.raises(ValueError):
        search.search(df, {"term": {"x": 1}}, strict=True)
    assert [r.i for r in search.page(search.search(df), "i", 1, 1).collect()] == [2]
    assert search.search_many({"a": df, "b": df}, {"match": {"city": "lah"}}, "none").count() == 2


def test_profile_of_dirty_rows(spark):
    rows = [
        ("CUST-1", " 0300-1234567", "a@b.example", "28", "1996-05-14", "PKR 145,000", "35201-1234567-1", "House 5, Canal Road", None),
        ("CUST-2", "+92 321 7654321", None, "145", "15/08/1990", "Rs. 95000", "3520212345671", "12 Main Street, Lahore", None),
        ("CUST-3", None, "c@d.example", "31", None, "$2,500", None, "Flat 7, Block B, Karachi", None),
    ]
    df = spark.createDataFrame(rows, "cust_id string, mob_number string, user_email string, patient_age string, d_o_b string, salary_pkr string, nic_number string, shipping_address string, qqqq string")
    got = {r.col_name: r for r in profile.profile(df).collect()}
    assert {c: r.detected_type for c, r in got.items()} == {
        "cust_id": "categorical", "mob_number": "phone_pakistan", "user_email": "email", "patient_age": "age", "d_o_b": "date", "salary_pkr": "currency_amount",
        "nic_number": "cnic_pakistan", "shipping_address": "address", "qqqq": "unknown",
    }
    age = got["patient_age"]
    assert (age.min_value, age.max_value, age.median_value, age.unique_count, age.null_count) == (28.0, 145.0, 31.0, 3, 0)
    assert got["qqqq"].null_percentage == 1.0 and got["mob_number"].confidence_score >= 0.8
    assert profile.dataset_summary(df.union(df)).first().asDict() == {"row_count": 6, "duplicate_rows": 3, "col_count": 9}


def test_reports(spark):
    df = spark.createDataFrame([(0, "anna khan", 1), (1, "anna khann", 1), (2, "anna khan", 1), (3, None, None)], "i int, x string, n int")
    assert dedup.dedup_report(df, "i", ["x"]).first().asDict() == {"initial_rows": 4, "exact_duplicates_removed": 1, "fuzzy_duplicates_removed": 1, "final_rows": 2}
    plan = TablePlan({"x": ColumnPlan(T.CITY), "n": ColumnPlan(impute=Impute.CONSTANT, constant="none")})
    got = {r.col_name: tuple(r)[1:] for r in impute.impute_report(df, plan, "i").collect()}
    assert got == {"x": ("mode", 1, 1, "anna khan"), "n": ("constant", 1, 0, "none")}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_token_score(a, b):
    """By the definition, over all stretches."""
    a, b = a.strip().lower(), b.strip().lower()
    if a == b:
        return 1.0
    if a in b or b in a:
        return max(0.85, min(len(a), len(b)) / max(len(a), len(b), 1))
    ratio = lambda x, y: 2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0
    words = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    part = 0.0
    for x, y in ((a, b), (b, a)):
        if len(x) <= len(y):
            n = len(x)
            stretches = [y[i : i + n] for i in range(len(y) - n + 1)] + [y[:i] for i in range(1, n)] + [y[-i:] for i in range(1, n)]
            part = max([part, *(ratio(x, s) for s in stretches)])
    return max(words, 0.9 * part)


def test_token_scores_are_those_of_the_definition():
    import random

    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("aab c") for _ in range(rng.randint(0, 9))).strip() for _ in "ab")
        assert abs(similarity.token_score(a, b) - plain_token_score(a, b)) < 1e-12, (a, b)
        least = rng.random()
        found = similarity.token_score(a, b, least)
        assert abs(found - plain_token_score(a, b)) < 1e-12 or max(found, plain_token_score(a, b)) < least


@pytest.mark.parametrize("threshold, keys", [(0.7, ["name"]), (0.85, ["name", "more"]), (0.95, ["name"])])
def test_token_pairs_are_all_pairs(spark, threshold, keys):
    import random

    rng = random.Random(int(100 * threshold))
    words = ["anna", "maria", "smith", "jones", "o", "van", "der", "berg", "élan", "lee"]
    rows = []
    for i in range(90):
        name = rng.sample(words, rng.randint(1, 4))
        if rng.random() < 0.4:
            name[0] = name[0].replace(rng.choice(name[0]), rng.choice("xyz"), 1)
        rows.append((i, "k" if i % 2 else "l", " ".join(name) + rng.choice(("", " ", "s")), rng.choice((None, "", "Z"))))
    rows += [(200 + i, "m", t, None) for i, t in enumerate(("a", "b", "A", "ab", "ba", "abc", "cab", "abd", "a b", "b a", "bc"))]
    df = spark.createDataFrame([*rows, (900, "k", None, None), (901, None, "anna lee", "")], "i int, block string, name string, more string").repartition(3)
    got = {(r.a, r.b): r.score for r in dedup.similar_pairs(df, keys, "i", threshold, F.col("block"), "tokens").collect()}
    texts = {i: f"{n} | {m or ''}" if len(keys) == 2 else n for i, _, n, m in rows}
    expected = {}
    for i, k, *_ in rows:
        for j, other, *_ in rows:
            x, y = texts[i], texts[j]
            if i < j and k == other and min(len(x), len(y)) / max(len(x), len(y)) >= 0.7 and (score := plain_token_score(x, y)) >= threshold:
                expected[i, j] = score
    assert len(expected) >= 2 and set(got) == set(expected)
    assert all(abs(got[p] - expected[p]) < 1e-12 for p in got)
    kept = dedup.drop_similar(df, keys, "i", threshold, F.col("block"), "tokens")
    gone = set()
    for i, *_ in rows:
        if i not in gone:
            gone |= {b for a, b in expected if a == i}
    assert {r.i for r in kept.collect()} == {i for i, *_ in rows if i not in gone} | {900, 901}
    with pytest.raises(ValueError):
        dedup.similar_texts(df, 0.5, "tokens")


def test_close_pairs_are_those_of_the_definition():
    import random

    rng = random.Random(11)
    stems = ["blue ring", "9f3a 77b1 old plate", "tiny", "a", "ab", "", "x" * 70 + " long text of many letters", "größe kalt"]
    texts = []
    for _ in range(150):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice("ab 9x")) if rng.random() < 0.6 or not t else t.pop(rng.randrange(len(t)))
        words = "".join(t).split()
        rng.shuffle(words)
        texts.append(" ".join(words))
    for least in (2 / 3, 0.85, 0.95, 1.0):
        want = {(i, j): s for j, y in enumerate(texts) for i, x in enumerate(texts[:j]) if (s := plain_token_score(x, y)) >= least}
        got = {(i, j): s for i, j, s in similarity.close_pairs(texts, None, least)}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
        across = {(i, j + 50) for i, j, _ in similarity.close_pairs(texts[:50], texts[50:], least)}
        assert across == {(i, j) for i, j in want if i < 50 <= j}


def test_chunks_of_tokens_meet_once(spark, monkeypatch):
    from sparkloom.operators import dedup

    monkeypatch.setattr(dedup, "CHUNK", 7)
    rows = [(i, f"{'alpha beta' if i % 2 else 'beta alpha'} {i // 4:05d}") for i in range(60)]
    got = dedup.similar_pairs(spark.createDataFrame(rows, "i long, x string"), ["x"], "i", 0.9, mode="tokens").collect()
    want = {(i, j) for j, y in rows for i, x in rows[:j] if plain_token_score(x, y) >= 0.9}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def test_many_random_codes_are_paired_fast():
    """The candidates that shared grams gave here were scored one by one, 374,000 pairs in 20 s."""
    import hashlib
    import time

    texts = [f"{(h := hashlib.md5(str(i // 3).encode()).hexdigest())[:8]} {h[8:16]} large ring" + "x" * (i % 3) for i in range(2000)]
    began = time.process_time()
    found = similarity.close_pairs(texts, None, 0.85)
    assert time.process_time() - began < 8 and {(i // 3, j // 3) for i, j, _ in found} == {(g, g) for g in range(667)}


@pytest.mark.parametrize("least", [2 / 3, 0.85, 1.0])
@pytest.mark.parametrize("small", [True, False])
def test_close_pairs_of_many_letters_lengths_and_equal_words(monkeypatch, least, small):
    import random

    if small:
        for name, value in (("_ROWS", 3), ("_BOX", 2), ("_BLOCK", 16), ("_BATCH", 8), ("_SAME", 2), ("_LETTERS", 5)):
            monkeypatch.setattr(similarity, name, value)
    rng = random.Random(5)
    stems = ["3f a9 red gear", "b c d", "anna  lee\tsmith", "".join(chr(0x4E00 + k) for k in range(68)), "x y" * 22, "", "0 1 2 3", "\U0001f600 é"]
    texts = []
    for _ in range(80):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 4)):
            t.insert(rng.randint(0, len(t)), rng.choice("ab 9é")) if rng.random() < 0.6 or not t else t.pop(rng.randrange(len(t)))
        words = "".join(t).split(" ")
        rng.shuffle(words)
        texts.append(" ".join(words).strip(" "))
    want = {(i, j): s for j, y in enumerate(texts) for i, x in enumerate(texts[:j]) if (s := similarity.token_score(x, y)) >= least}
    found = similarity.close_pairs(texts, None, least)
    got = {(i, j): s for i, j, s in found}
    assert len(got) == len(found) and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    found = similarity.close_pairs(texts[:30], texts[30:], least)
    assert len({r[:2] for r in found}) == len(found) and {(i, j + 30) for i, j, _ in found} == {(i, j) for i, j in want if i < 30 <= j}
    sizes = np.array([len(x) for x in texts])
    fit = lambda i, j: min(sizes[i], sizes[j]) >= 0.7 * max(sizes[i], sizes[j])
    assert {r[:2] for r in similarity.close_pairs(texts, None, least, sizes) if fit(*r[:2])} == {p for p in want if fit(*p)}


def test_many_texts_are_told_apart_by_counts_of_letters():
    """Each pair used to be compared by its pairs of letters: 30,000 texts took 24 s of one core."""
    import hashlib
    import time

    names = [f"{a} {b}" for a in ("red", "old", "small", "cold") for b in ("bolt", "ring", "gear", "plate")]
    texts = [f"{(h := hashlib.md5(str(i // 2).encode()).hexdigest())[:8]} {h[8:16]} {names[i // 2 % 16]}" + "x" * (i % 2) for i in range(30_000)]
    began = time.process_time()
    found = similarity.close_pairs(texts, None, 0.85)
    assert time.process_time() - began < 8 and {(i // 2, j // 2) for i, j, _ in found} >= {(g, g) for g in range(15_000)}
    assert all(plain_token_score(texts[i], texts[j]) >= 0.85 for i, j, _ in found[:100])


def test_texts_of_the_same_words_fill_more_than_a_chunk(spark, monkeypatch):
    import itertools

    monkeypatch.setattr(dedup, "CHUNK", 7)
    rows = [(i, " ".join(p)) for i, p in enumerate([*itertools.permutations("red ring 12 k".split()), *itertools.permutations("blue ring 12".split())])]
    df = dedup.similar_pairs(spark.createDataFrame(rows, "i long, x string"), ["x"], "i", 0.9, mode="tokens")
    got = df.collect()
    want = {(i, j) for j, y in rows for i, x in rows[:j] if plain_token_score(x, y) >= 0.9}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    # The texts are compared once, not once for either way round.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
