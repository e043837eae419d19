import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import prose
from sparkloom.llm import lm_scoring as M
from sparkloom.llm.common import table


def small(monkeypatch):
    for name, value in {"CLUSTERS": 5, "MEMBERS": 4, "DIMENSIONS": 6}.items():
        monkeypatch.setattr(M, name, value)


def texts_by(rng, n=6, size=9):
    """Texts of the tokens that five clusters of four have: the rare one, and those from the second cluster on."""
    return [rng.choice([1, *range(5, 21)], rng.integers(1, size)).astype(np.uint16) for _ in range(n)]


def test_gradient_matches_differences(monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in M.initial([5, 4, 3, 2] * 4, 7).items()}
    near, tokens = M.windows(*M.laid_out(texts_by(rng)))
    _, g = M.gradient(p, near, tokens)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p[k].shape)
            if k in ("left", "right"):
                at = (near[0 if k == "left" else -1][3], at[1])
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += 1e-5
            up = M.gradient(q, near, tokens)[0]
            q[k][at] -= 2e-5
            assert abs((up - M.gradient(q, near, tokens)[0]) / 2e-5 - g[k][at]) < 1e-6, k


def test_scores_are_log_probabilities_of_a_whole_distribution(monkeypatch):
    """By brute force: the probabilities of all tokens at a place add up to one, and a text's score adds up its tokens'."""
    small(monkeypatch)
    rng = np.random.default_rng(1)
    p = {k: v + rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in M.initial([5] * 16, 5).items()}
    texts = texts_by(rng, 12)
    got = M.score(p, [*texts, np.empty(0, np.uint16)])
    for name, value in {"LAID_OUT": 11, "BLOCK": 4}.items():
        monkeypatch.setattr(M, name, value)
        assert np.allclose(M.score(p, [*texts, np.empty(0, np.uint16)]), got, atol=1e-4)
    assert len(M.score(p, [])) == 0
    for t, found in zip(texts, got):
        total, padded = 0.0, [0, 0, *t.tolist(), 0, 0]
        for i in range(2, len(padded) - 2):
            s = p["shift"].astype(float)
            for j, o in enumerate(M.OFFSETS):
                s = s + p["near"][j] * p["left" if o < 0 else "right"][padded[i + o]]
            h = np.tanh(s)
            z = np.exp(p["cluster"] @ h + p["cluster_bias"])
            each = []
            each.extend([z[0] / z.sum(), 0, 0, 0])
            for c in range(1, M.CLUSTERS):
                w = np.exp(p["word"][c * M.MEMBERS : (c + 1) * M.MEMBERS] @ h + p["word_bias"][c * M.MEMBERS : (c + 1) * M.MEMBERS])
                each.extend(z[c] / z.sum() * w / w.sum())
            assert abs(sum(each) - 1) < 1e-6
            total += np.log(each[padded[i] - 1])
        assert abs(total - found) < 1e-3
    assert got[-1] == 0


def test_spelling_is_a_distribution_and_adds_up(spark):
    words = ["abc", "abd", "b", "cab", "\0", "ä"]
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(2)
    spelling = M.spelling_of(counts, spark.createDataFrame([("cab",)], "word string"))
    p = np.exp(spelling.log_p.reshape(M.SYMBOLS, M.SYMBOLS, M.SYMBOLS))
    p[:, :, M.OTHER] *= M.OTHER_LETTERS
    assert np.allclose(p.sum(axis=2), 1)
    symbol = {chr(c): i + 1 if i else 0 for i, c in enumerate(spelling.letters)}
    assert "c" in symbol and "ä" in symbol

    def one(word):
        s = [0, 0, *(symbol.get(x, M.OTHER) for x in word.replace("\0", "\ufffe")), 0]
        return sum(np.log(p[a, b, c]) - (np.log(M.OTHER_LETTERS) if c == M.OTHER else 0) for a, b, c in zip(s, s[1:], s[2:]))

    tried = ["abc", "b", "zzz", "cabä", "x", "", "a\0b"]
    assert np.allclose(spelling.score(tried), [one(w) for w in tried]) and len(spelling.score([])) == 0
    expected = Counter()
    for i, w in enumerate(words):
        if w != "cab":
            s = [0, 0, *(symbol.get(x, M.OTHER) for x in w.replace("\0", "\ufffe")), 0]
            for abc in zip(s, s[1:], s[2:]):
                expected[abc] += i + 1
    total = np.zeros(M.SYMBOLS**3)
    for (a, b, c), n in expected.items():
        total[(a * M.SYMBOLS + b) * M.SYMBOLS + c] = n
    assert np.allclose(np.exp(M.spelling_model(total)), p.reshape(-1))


def test_networks_average_by_windows():
    import pandas as pd

    p = M.initial([3, 2], 1)
    q = M.squares(p)
    more = {k: v + 1 for k, v in p.items()}
    got = M._average(pd.DataFrame({"part": [2, 2], "seen": [1, 3], "network": [M.pack(p, q), M.pack(more, q)]}))
    mean, sums = M.unpack(got["network"][0], p)
    assert got["seen"][0] == 4 and all(np.allclose(mean[k], p[k] + 0.75, atol=1e-5) for k in p) and all(np.allclose(sums[k], q[k]) for k in q)


def test_words_and_documents_are_counted_whole(spark, docs, rows, monkeypatch):
    for name in ("HELD_WORDS", "SPELLED"):
        monkeypatch.setattr(M, name, 5)
    expected = Counter(w for _, t in rows for w in M.words_of(t))
    assert {r.word: r.n for r in M.word_counts(docs).collect()} == expected
    vocab, spelling, _, tokens = M.fitted(docs)
    assert sorted(vocab.values()) == list(range(M.MEMBERS + 1, M.MEMBERS + 1 + len(vocab))) and set(vocab) == set(expected)
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u2"))) for r in tokens.collect())
    assert got == Counter((d, tuple(vocab[w] for w in M.words_of(t))) for d, t in rows)


def test_long_corpora_draw_windows_of_all_documents(monkeypatch):
    seen = []
    monkeypatch.setattr(M, "MIXED", 50)
    monkeypatch.setattr(M, "step", lambda p, q, near, tokens: seen.append(len(tokens)))
    rng = np.random.default_rng(3)
    texts = texts_by(rng, 300)
    n = sum(map(len, texts))
    assert abs(M.descend({}, {}, iter([texts]), 1 / 8, 0) - n / 8) < n / 40 and sum(seen) < n / 6
    assert M.descend({}, {}, iter([texts]), 2.0, 0) == 2 * n
    assert M.descend({}, {}, iter([[]]), 2.0, 0) == 0


@pytest.mark.parametrize(("n_windows", "times"), [(10**10, 1), (24 * 10**6, 1), (2 * 10**6, 2), (1, 40)])
def test_training_takes_every_window_of_every_document(spark, monkeypatch, n_windows, times):
    rng = np.random.default_rng(4)
    texts = texts_by(rng, 200)
    start = M.initial([5] * 16, 5)

    def counted(p, q, texts, draws, seed):
        n = draws * sum(len(t) for some in texts for t in some)
        p["shift"][0] += n
        return max(1, round(n))

    monkeypatch.setattr(M, "descend", counted)
    tokens = spark.createDataFrame([(t.tobytes(), i % sum(M.ROUNDS)) for i, t in enumerate(texts)], "ids binary, share int").coalesce(1)
    assert M.train(tokens, start, n_windows)["shift"][0] == times * sum(map(len, texts))


def test_steps_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(M, "STEP", 7)
    monkeypatch.setattr(M, "MIXED", 600)
    seen = []
    monkeypatch.setattr(M, "step", lambda p, q, near, tokens: seen.append([*zip(*(x.tolist() for x in near), tokens.tolist())]))
    texts = texts_by(np.random.default_rng(8), 500)
    near, tokens = M.windows(*M.laid_out(texts))
    assert M.descend({}, {}, iter([texts[:300], texts[300:]]), 1, 0) == len(tokens)
    assert Counter(w for some in seen for w in some) == Counter(zip(*(x.tolist() for x in near), tokens.tolist()))
    assert all(3 <= len(some) <= 7 + 600 // M.STEPS for some in seen)


def test_pieces_have_the_words_of_their_texts(monkeypatch):
    texts = ["a\x1cb a,b\u00a0c\u2028d\x85e", "\u0130x \u03a3\u03a3 STRASSE \u00df", "", None, " \t\n\v\f\r ", "x_y--z\n\nx_y a a A\0b", "\U0001f600\u0301 \U0001d7d8 \u0e01\u0e34", "tail "] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    vocab = M.tokens_of([("a", 9), ("x_y", 5), ("-", 4), ("\u03c3\u03c2", 1)])
    spelling = M.Spelling(np.array([0, *map(ord, "abcdxyz")]), np.log(np.random.default_rng(6).uniform(0.1, 1, M.SYMBOLS**3)))
    for split, spelled in ((1, 2), (20, 3), (1 << 20, 1 << 15)):
        monkeypatch.setattr(M, "SPLIT", split)
        monkeypatch.setattr(M, "SPELLED", spelled)
        words, rows = Counter(), []
        for found in M._count_words(iter([batch.slice(0, 5), batch.slice(5)])):
            words.update(dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist())))
        assert words == Counter(w for t in texts for w in M.words_of(t))
        for found in M._encode(vocab, spelling)(iter([batch.slice(0, 5), batch.slice(5)])):
            rows.extend(found.to_pylist())
        assert [r["doc_id"] for r in rows] == list(range(len(texts)))
        for r, t in zip(rows, texts):
            assert np.frombuffer(r["ids"], "<u2").tolist() == [vocab.get(w, M.RARE) for w in M.words_of(t)]
            assert abs(r["spelled"] - spelling.score([w for w in M.words_of(t) if w not in vocab]).sum()) < 1e-9


def test_gradient_and_scores_are_the_same_in_pieces_of_any_size(monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(9)
    p = {k: v.astype(np.float64) for k, v in M.initial([5] * 16, 5).items()}
    near, tokens = M.windows(*M.laid_out(texts_by(rng, 60)))
    loss, g = M.gradient(p, near, tokens)
    each = M.log_probabilities(p, near, tokens)
    assert abs(loss + each.mean()) < 1e-9
    monkeypatch.setattr(M, "ROWS", 13)
    assert all(np.allclose(v, g[k]) for k, v in M.gradient(p, near, tokens)[1].items()) and np.allclose(M.log_probabilities(p, near, tokens), each)


def test_held_out_documents_are_likelier_than_by_unigrams_and_bigrams(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = spark.createDataFrame([r for r in rows if not held(r[0])], "doc_id long, text string").repartition(3)
    vocab, _, p, _ = M.fitted(train)
    encode = lambda t: np.array([vocab.get(w, M.RARE) for w in M.words_of(t)], np.uint16)
    known, others = ([encode(t) for d, t in rows if held(d) == h] for h in (False, True))
    n = sum(map(len, others))
    nats = -M.score(p, others).sum() / n
    one = np.bincount(np.concatenate(known), minlength=M.MEMBERS + 1 + len(vocab)) + 0.5
    one[0], one[M.RARE + 1 : M.MEMBERS + 1] = 0, 0
    one = one / one.sum()
    unigram = -np.log(one[np.concatenate(others)]).sum() / n
    pairs, firsts = Counter(), Counter()
    for t in known:
        pairs.update(zip([0, *t.tolist()], t.tolist()))
        firsts.update([0, *t.tolist()[:-1]])
    bigram = -sum(np.log((pairs[a, b] + 20 * one[b]) / (firsts[a] + 20)) for t in others for a, b in zip([0, *t.tolist()], t.tolist())) / n
    print(f"nats a token: network {nats:.3f}, bigrams {bigram:.3f}, unigrams {unigram:.3f}")
    assert nats < bigram - 0.1 and bigram < unigram


def test_junk_scores_lower_than_prose(spark):
    rng = np.random.default_rng(5)
    texts = [(i, prose(120, 500 + i % 40)) for i in range(150)]
    junk = ["".join(chr(c) for c in rng.integers(97, 123, 7)) for _ in range(60)]
    texts += [(900, " ".join(junk)), (901, " ".join(sorted(prose(60, 3).split()))), (902, None), (903, ""), (903, "")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in M.lm_scores(docs).collect()}
    assert got[900].mean_log_likelihood < min(got[i].mean_log_likelihood for i in range(150)) - 2
    assert got[902].n_tokens == 0 and got[902].mean_log_likelihood is None and got[903].log_likelihood == 0
    assert all(abs(r.log_likelihood - r.n_tokens * (r.mean_log_likelihood or 0)) < 1e-6 for r in got.values())


def test_empty_table(empty):
    assert M.lm_scores(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7])
def test_windows_stop_at_the_edges(n):
    near, tokens = M.windows(*M.laid_out([np.arange(1, n + 1, dtype=np.uint16), np.array([9], np.uint16)]))
    assert tokens.tolist() == [*range(1, n + 1), 9] and all(x[-1] == 0 for x in near)
    assert near[M.OFFSETS.index(1)].tolist() == [*range(2, n + 1), *([0] if n else []), 0]
