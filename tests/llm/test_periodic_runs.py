import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import periodic_runs as P


def plain_runs(words):
    """Every maximal stretch by its definition: all starts, all periods, the smallest period of each stretch."""
    n, found = len(words), []

    def has(a, b, q):
        return all(words[i] == words[i + q] for i in range(a, b - q))

    for q in range(1, n // 4 + 1):
        a = 0
        while a + q < n:
            b = a + q
            while b < n and words[b] == words[b - q]:
                b += 1
            if b - a >= max(6, 4 * q) and not any(has(a, b, r) for r in range(1, q)) and (a == 0 or words[a - 1] != words[a - 1 + q]):
                found.append((a, b - a, q))
            a += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    runs = plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return len(words), runs, best, " ".join(w for i, w in enumerate(words) if i not in gone)


repeats = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(repeats)
def test_runs_are_those_of_the_definition(parts):
    words = [b"%d" % x for part, times in parts for x in part * times]
    runs = P.runs_of(P.numbered(words)) if words else []
    assert runs == plain_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    assert P.collapse(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_long_zeros():
    assert P.long_zeros(0b0100001, 7, 3) == 0b0000110
    assert P.long_zeros(0, 5, 5) == 1 and P.long_zeros(0, 5, 6) == 0


def test_one_long_repetition():
    assert P.runs_of(np.zeros(50_000, np.int32)) == [(0, 50_000, 1)]
    ids = np.concatenate([np.arange(3000), np.tile(np.arange(7000, 7700), 8)])
    assert P.runs_of(ids) == [(3000, 5600, 700)]


def test_rows_of_all_kinds(spark, docs, rows, empty):
    more = [(20, "a b " * 40 + "c d e f " * 5 + "a b " * 9), (21, "x y z " * 6), (22, "\x1c \x1c \x1c \x1c \x1c \x1c"), (None, "n n n n n n n"), (None, None)]
    table = docs.select("doc_id", "text", "label").union(spark.createDataFrame([(d, t, "") for d, t in more], "doc_id long, text string, label string"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in P.periodic_runs(table).collect()), key=repr)
    short = [g for g in got if g[1] < 1000]
    assert short == sorted(((d, *plain(t or "")) for d, t in [*rows, *more] if len((t or "").split()) < 1000), key=repr)
    assert len(got) == len(rows) + len(more)
    assert P.periodic_runs(empty).collect() == []


def test_query_by_brute_force(spark, tiny):
    """All documents of up to 400 words and their repetitions, by the contract."""
    seen = 0
    got = {r.doc_id: r for r in P.op13_periodic_runs(spark, tiny).collect()}
    docs = spark.read.parquet(f"{tiny}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall("[^\x20\x09-\x0d]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if n > 400:
            continue
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        _, runs, best, text = plain(" ".join(words))
        seen += len(runs)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None, None, None)))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert seen
