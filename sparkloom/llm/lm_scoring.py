"""Masked pseudo-likelihood of documents under a bidirectional window network trained in numpy.

The network predicts each token from REACH neighbours on either side: their embeddings, weighted by distance, add up, pass
through tanh, and a softmax over the vocabulary follows in two steps, first the cluster of a word, then the word within it.
The vocabulary is the most frequent words of the corpus. A word beyond them is the token RARE, and its letters are scored
by a trigram model of the spelling of such words, so a text's score is the log-probability of its very words.

Words are counted over all documents, and training takes every window of every document, each as often as any other. It
goes in rounds over growing shares of the documents: each task descends on its share's windows from the same parameters, and
the results are averaged, by windows, in tasks that take FAN_IN of them at a time. The driver gets one network a round.
Scoring sums the conditional log-probabilities of all tokens of a text, each predicted from both sides, and of the spelling
of its rare words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import cut, discard, map_arrow, table

WORD = re.compile(r"\w+|[^\w\s]")
WORD_OR_BREAK = re.compile(r"\w+|[^\w\s]|\n")
#: Tokens: 0 is the edge of a text, RARE a word beyond the vocabulary, which has the first cluster for itself.
RARE = 1
#: Clusters of the output, and words in each; the frequent words fill those from the second on, in order of their counts.
CLUSTERS = 64
MEMBERS = 64
#: Neighbours on either side.
REACH = 2
#: Even.
DIMENSIONS = 32
#: Sixteenths of the documents in each round; together they are all documents.
ROUNDS = (1, 1, 2, 4, 8)
#: Windows of a step, at least; tokens that a task mixes at a time make STEPS steps, if those hold no more than MOST windows.
STEP = 4096
STEPS = 32
MOST = 32768
MIXED = 1 << 20
#: Windows scored at a time, and rows of a matrix that are worked on at a time.
BLOCK = 1 << 16
ROWS = 2048
#: Tokens that a task scores, and rare words that it spells, at a time.
LAID_OUT = 1 << 17
SPELLED = 1 << 15
RATE = 0.08
#: Training takes every window once, or more often, up to MOST_PASSES times, as long as that makes fewer than LEAST_WINDOWS.
MOST_PASSES = 40
LEAST_WINDOWS = 3_000_000
#: Networks that one task averages.
FAN_IN = 8
#: Bytes of texts that a task splits at a time; a longer text by itself.
SPLIT = 1 << 22
#: Distinct pieces of texts between white space that a counting task holds before it emits the counts of their words.
HELD_WORDS = 400_000
#: Symbols of the spelling model: the edge of a word, any other letter, and the most frequent letters.
SYMBOLS = 64
OTHER = 1
#: Letters that OTHER stands for, taken as equally likely.
OTHER_LETTERS = 1 << 16
#: Weight of the shorter context's estimate in the spelling model.
PRIOR = 10.0
SEED = 7

Params = dict[str, np.ndarray]
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


# Texts in pieces.


def pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[str], np.ndarray]]:
    """Some rows at a time, from and up to which: where each row's pieces between white space begin and end, the different
    pieces, and which of those each piece is.

    No word goes across white space, so that each different piece need be split into words once.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    parts = np.flatnonzero(np.r_[True, np.diff(ends // SPLIT) > 0, True]).tolist() if len(ends) else []
    for i, j in zip(parts[:-1], parts[1:]):
        texts = [(t or "").lower() for t in batch.column("text").slice(i, j - i).to_pylist()]
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        found = split.values.dictionary_encode()
        yield i, j, split.offsets.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()


def words_of_pieces(pieces: list[str]) -> list[str]:
    """The words of all pieces, and a line break between those of a piece and the next."""
    return WORD_OR_BREAK.findall("\n".join(pieces))


# The vocabulary.


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        words: dict[str, int] = {}
        times = iter(counts.values())
        n = next(times)
        for w in words_of_pieces(list(counts)):
            if w == "\n":
                n = next(times)
            else:
                words[w] = words.get(w, 0) + n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, _, pieces, which in pieces_of(batch):
            for piece, n in zip(pieces, np.bincount(which, minlength=len(pieces)).tolist()):
                counts[piece] = counts.get(piece, 0) + n
            if len(counts) >= HELD_WORDS:
                yield flush()
    if counts:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all documents, as a table."""
    return cut(map_arrow(docs.select("text"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame) -> list[tuple[str, int]]:
    """The words that the network knows (ties: in order of the word) with their counts; as many as the clusters hold."""
    return [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit((CLUSTERS - 1) * MEMBERS).collect()]


def tokens_of(known: list[tuple[str, int]]) -> dict[str, int]:
    return {w: MEMBERS + 1 + k for k, (w, _) in enumerate(known)}


# The spelling of rare words.


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the words, each between zeros, and where each word begins."""
    joined = "\0".join(w.replace("\0", "\ufffe") for w in words)
    flat = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "surrogatepass"), "<u4")
    return flat, np.flatnonzero(flat == 0)[:-1]


class Spelling:
    """Log-probabilities of a symbol after two others, for letters by their code points; ``letters`` begins with 0, the edge."""

    def __init__(self, letters: np.ndarray, log_p: np.ndarray):
        self.letters = letters
        self.log_p = log_p.reshape(-1, SYMBOLS).copy()
        self.log_p[:, OTHER] -= np.log(OTHER_LETTERS)
        self.symbol = np.full(0x110000, OTHER, np.int32)
        self.symbol[letters] = [0, *range(OTHER + 1, OTHER + len(letters))]

    def trigrams(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the symbols that follow each other, two before each, and where each word begins."""
        points, begin = letters_of(words)
        s = self.symbol[points]
        before = np.empty(len(s) - 1, np.int32)
        before[1:] = s[:-2]
        before[begin] = 0  # what stands two before a word's first letter belongs to another word
        before *= SYMBOLS
        before += s[:-1]
        before *= SYMBOLS
        before += s[1:]
        return before, begin

    def score(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word's letters and of its end."""
        if not words:
            return np.empty(0)
        found, begin = self.trigrams(words)
        return np.add.reduceat(self.log_p.reshape(-1)[found], begin)


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        words = batch.column("word").to_pylist()
        if words:
            points, begin = letters_of(words)
            n = np.repeat(batch.column("n").to_numpy().astype(np.float64), np.diff(np.r_[begin, len(points) - 1]))
            letters, where = np.unique(points[:-1], return_inverse=True)
            counts.update(dict(zip(letters.tolist(), np.bincount(where, n).astype(np.int64).tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["letter", "n"])


def _count_trigrams(letters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling, total = Spelling(letters, np.zeros(SYMBOLS**3)), np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            words = batch.column("word").to_pylist()
            if words:
                found, begin = spelling.trigrams(words)
                n = np.repeat(batch.column("n").to_numpy().astype(np.float64), np.diff(np.r_[begin, len(found)]))
                total += np.bincount(found, n, SYMBOLS**3).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["trigram", "n"])

    return run


def spelling_of(counts: DataFrame, known: DataFrame) -> Spelling:
    """The spelling model of the words that are not among the ``known`` ones; SYMBOLS^3 counts at most reach the driver."""
    rare = counts.join(F.broadcast(known), "word", "left_anti")  # known is bounded by the vocabulary
    found = map_arrow(rare, _count_letters, "letter long, n long").where("letter > 0").groupBy("letter").agg(F.sum("n").alias("n"))
    letters = np.array([0, *sorted(r["letter"] for r in found.orderBy(F.desc("n"), "letter").limit(SYMBOLS - 2).collect())], np.int64)
    rows = map_arrow(rare, _count_trigrams(letters), "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SYMBOLS**3)
    total[rows.column("trigram").to_numpy()] = rows.column("n").to_numpy()
    return Spelling(letters, spelling_model(total))


def spelling_model(total: np.ndarray) -> np.ndarray:
    """Log-probabilities by trigram; contexts fall back on shorter ones with the weight PRIOR."""
    three = total.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p = (one + 1) / (one.sum() + SYMBOLS)
    p = (two + PRIOR * p) / (two.sum(axis=1, keepdims=True) + PRIOR)
    p = (three + PRIOR * p) / (three.sum(axis=2, keepdims=True) + PRIOR)
    return np.log(p).reshape(-1)


# Documents as tokens.


class Numbers(dict):
    """The tokens of words; RARE of any other."""

    def __missing__(self, word: str) -> int:
        return RARE


def _encode(vocab: dict[str, int], spelling: Spelling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(vocab)
        numbers["\n"] = 0
        for batch in batches:
            for i, j, begin, pieces, which in pieces_of(batch):
                words = words_of_pieces(pieces)
                ids = np.fromiter(map(numbers.__getitem__, words), np.uint16, len(words))
                breaks = np.flatnonzero(ids == 0)
                start, stop = np.r_[0, breaks + 1][: len(pieces)], np.r_[breaks, len(ids)][: len(pieces)]
                n, rare, spelled = stop - start, np.flatnonzero(ids == RARE), np.zeros(len(pieces))
                for k in range(0, len(rare), SPELLED):
                    some = rare[k : k + SPELLED]
                    np.add.at(spelled, np.searchsorted(breaks, some), spelling.score([words[at] for at in some.tolist()]))
                # From different pieces to those of the texts.
                ends = np.r_[0, np.cumsum(n[which])]
                flat = ids[np.repeat(start[which] - ends[:-1], n[which]) + np.arange(ends[-1])].astype("<u2").tobytes()
                at = (2 * ends[begin]).tolist()
                blobs = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
                row = np.repeat(np.arange(j - i), np.diff(begin))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(blobs, pa.binary()),
                        pa.array(np.bincount(row, spelled[which], j - i), pa.float64()),
                        pa.array([xxhash.xxh32_intdigest(blob) % sum(ROUNDS) for blob in blobs], pa.int32()),
                    ],
                    names=["doc_id", "ids", "spelled", "share"],
                )

    return run


def encoded(docs: DataFrame, vocab: dict[str, int], spelling: Spelling) -> DataFrame:
    """doc_id, the tokens as unsigned 16-bit integers, the log-probability of the rare words' letters, and the share of the
    documents (by their tokens) that each is in; as a table."""
    return cut(map_arrow(docs.select("doc_id", "text"), _encode(vocab, spelling), "doc_id long, ids binary, spelled double, share int"))


def laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after another with edges between them, and the places of the tokens."""
    edge = np.zeros(REACH, np.uint16)
    flat = np.concatenate([edge, *(x for t in texts for x in (t, edge))])
    return flat, np.flatnonzero(flat)


def windows(flat: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The neighbours at each of OFFSETS and the tokens, for some places; 0 beyond a text's edges."""
    return [flat[at + o].astype(np.int64) for o in OFFSETS], flat[at].astype(np.int64)


# The network.


def initial(counts: list[int], n_rare: int, seed: int = SEED) -> Params:
    """Random embeddings; biases that give each token its frequency. ``counts`` are the known words', ``n_rare`` of all others."""
    rng = np.random.default_rng(seed)
    size, d = CLUSTERS * MEMBERS, DIMENSIONS
    n = np.zeros(size)
    n[0] = max(n_rare, 0.5)
    n[MEMBERS : MEMBERS + len(counts)] = counts
    by_cluster = n.reshape(CLUSTERS, MEMBERS)
    log = lambda x: np.maximum(np.log(np.maximum(x, 1e-9)), -12.0)  # noqa: E731  tokens that don't occur stay out of the way
    p = {
        "left": rng.normal(0, 0.1, (size + 1, d)),
        "right": rng.normal(0, 0.1, (size + 1, d)),
        "near": np.repeat(1.0 / np.abs(np.array(OFFSETS))[:, None], d, axis=1),
        "shift": np.zeros(d),
        "cluster": rng.normal(0, 0.1, (CLUSTERS, d)),
        "cluster_bias": log(by_cluster.sum(axis=1) / max(n.sum(), 1)),
        "word": rng.normal(0, 0.1, (size, d)),
        "word_bias": log(by_cluster / np.maximum(by_cluster.sum(axis=1, keepdims=True), 1e-9)).reshape(-1),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def squares(p: Params) -> Params:
    """For each row of a parameter the sum of its squared gradients so far; zero at first."""
    return {k: np.full(v.shape[:1], 1e-6, np.float32) for k, v in p.items()}


def weighted(p: Params) -> list[np.ndarray]:
    """What the embeddings at each of OFFSETS add to the values that turn into the hidden ones, times -2."""
    tables = [-2 * p["near"][i] * p["left" if o < 0 else "right"] for i, o in enumerate(OFFSETS)]
    tables[0] -= 2 * p["shift"]
    return tables


def hidden(tables: list[np.ndarray], near: list[np.ndarray]) -> np.ndarray:
    h = np.empty((len(near[0]), tables[0].shape[1]), tables[0].dtype)
    more = np.empty((min(ROWS, len(h)), h.shape[1]), h.dtype)
    for a in range(0, len(h), ROWS):
        s = h[a : a + ROWS]
        np.take(tables[0], near[0][a : a + ROWS], axis=0, out=s, mode="clip")
        for table, x in zip(tables[1:], near[1:]):
            s += np.take(table, x[a : a + ROWS], axis=0, out=more[: len(s)], mode="clip")
        with np.errstate(over="ignore"):  # tanh(x) = 2 / (1 + exp(-2 x)) - 1
            np.exp(s, out=s)
        s += 1
        np.divide(2, s, out=s)
        s -= 1
    return h


def places(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where one place of each row is among all."""
    return np.arange(0, z.size, z.shape[1]) + at


def softmax_of(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The log-probability at one place of each row, and what the probabilities are made of: factors by row and place, factors
    by place, and sums by row to divide their products by.

    Hidden values lie between -1 and 1, so nothing overflows as long as the weights of a token add up to less than 80.
    """
    z = h @ weights.T
    own = z.reshape(-1)[places(z, at)] + bias[at]
    np.exp(z, out=z)
    of_place = np.exp(np.maximum(bias, -60))
    total = z @ of_place
    return own - np.log(total), z, of_place, total


def sorted_by_cluster(near: list[np.ndarray], tokens: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """The order by clusters; neighbours, clusters and places in them in that order; each cluster of several words that occurs,
    and its rows from and up to."""
    clusters = (tokens - 1) // MEMBERS
    order = np.argsort(clusters.astype(np.uint16), kind="stable")
    clusters = clusters[order]
    edges = np.searchsorted(clusters, np.arange(1, CLUSTERS + 1)).tolist()
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]), 1) if b > a]
    return order, [x[order] for x in near], clusters, tokens[order] - 1 - clusters * MEMBERS, spans


def log_probabilities(p: Params, near: list[np.ndarray], tokens: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    order, near, clusters, members, spans = sorted_by_cluster(near, tokens)
    h = hidden(tables or weighted(p), near)
    logp = np.empty(len(h), h.dtype)
    for a in range(0, len(h), ROWS):
        logp[a : a + ROWS] = softmax_of(h[a : a + ROWS], p["cluster"], p["cluster_bias"], clusters[a : a + ROWS])[0]
    for k, a, b in spans:
        own = slice(k * MEMBERS, (k + 1) * MEMBERS)
        logp[a:b] += softmax_of(h[a:b], p["word"][own], p["word_bias"][own], members[a:b])[0]
    out = np.empty_like(logp)
    out[order] = logp
    return out


def sum_rows(rows: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of what belongs to it; an even number of columns, added two at a time as complex numbers."""
    out, two = np.zeros((n, x.shape[1]), x.dtype), np.result_type(x.dtype, np.complex64)
    d, to, x = x.shape[1] // 2, out.view(two).reshape(-1), x.view(two)
    for a in range(0, len(rows), ROWS):
        np.add.at(to, (rows[a : a + ROWS, None] * d + np.arange(d)).reshape(-1), x[a : a + ROWS].reshape(-1))
    return out


def gradient(p: Params, near: list[np.ndarray], tokens: np.ndarray) -> tuple[float, Params]:
    """The loss and its gradient, a token."""
    n, loss = len(tokens), 0.0
    _, near, clusters, members, spans = sorted_by_cluster(near, tokens)
    h = hidden(weighted(p), near)
    g = {k: np.zeros_like(p[k]) for k in ("cluster", "cluster_bias", "word", "word_bias")}
    dh = np.zeros_like(h)

    def back(a: int, b: int, name: str, own: slice, at: np.ndarray) -> float:
        """Adds to the gradients of ``own`` rows of an output layer and of the hidden values from a up to b."""
        weights, hk = p[name][own], h[a:b]
        logp, z, of_place, total = softmax_of(hk, weights, p[name + "_bias"][own], at)
        z.reshape(-1)[places(z, at)] -= total / of_place[at]
        share = 1 / (n * total)
        g[name][own] += of_place[:, None] * (z.T @ (hk * share[:, None]))
        g[name + "_bias"][own] += of_place * (share @ z)
        more = z @ (of_place[:, None] * weights)
        more *= share[:, None]
        dh[a:b] += more
        return -float(logp.sum(dtype=np.float64)) / n

    for a in range(0, n, ROWS):
        loss += back(a, min(a + ROWS, n), "cluster", slice(None), clusters[a : a + ROWS])
    for k, a, b in spans:
        loss += back(a, b, "word", slice(k * MEMBERS, (k + 1) * MEMBERS), members[a:b])
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    g["shift"], g["near"] = dh.sum(axis=0), np.empty_like(p["near"])
    for side in ("left", "right"):
        of = [i for i, o in enumerate(OFFSETS) if (o < 0) == (side == "left")]
        g[side] = np.zeros_like(p[side])
        for i in of:
            by_word = sum_rows(near[i], dh, len(p[side]))
            g["near"][i] = (by_word * p[side]).sum(axis=0)
            g[side] += by_word * p["near"][i]
    return loss, g


def step(p: Params, q: Params, near: list[np.ndarray], tokens: np.ndarray) -> float:
    """One step of descent in place, each row's rate falling with its gradients so far."""
    loss, g = gradient(p, near, tokens)
    for k, x in g.items():
        q[k] += x * x if x.ndim == 1 else np.einsum("ij,ij->i", x, x) / x.shape[1]
        scale = RATE / np.sqrt(q[k])
        x *= scale if x.ndim == 1 else scale[:, None]
        p[k] -= x
    return loss


def descend(p: Params, q: Params, texts: Iterator[list[np.ndarray]], draws: float, seed: int) -> int:
    """Steps in place over windows drawn from lists of texts, mixed within MIXED tokens or so; returns the windows seen."""
    seen, held, n_held = 0, [], 0

    def spend() -> int:
        rng = np.random.default_rng(seed + seen)
        left, spent = draws, 0
        flat, at = laid_out(held)
        while left > 1e-9 and len(at):
            drawn = rng.permutation(at)[: max(1, round(min(left, 1.0) * len(at)))]
            size = max(STEP, min(MOST, len(at) // STEPS))
            for some in np.array_split(drawn, -(-len(drawn) // size)):
                step(p, q, *windows(flat, some))
            spent += len(drawn)
            left -= 1.0
        held.clear()
        return spent

    for some in texts:
        for t in some:
            held.append(t)
            n_held += len(t)
            if n_held >= MIXED:
                seen += spend()
                n_held = 0
    return seen + spend()


def pack(p: Params, q: Params) -> bytes:
    return b"".join(x[k].astype("<f4").tobytes() for x in (p, q) for k in p)


def unpack(blob: bytes, like: Params) -> tuple[Params, Params]:
    out, at = [], 0
    for shapes in (like, squares(like)):
        part = {}
        for k, v in shapes.items():
            part[k] = np.frombuffer(blob, "<f4", v.size, at).reshape(v.shape).copy()
            at += 4 * v.size
        out.append(part)
    return out[0], out[1]


def _average(group: pd.DataFrame) -> pd.DataFrame:
    """One network of several, weighted by the windows that they have seen."""
    total = int(group["seen"].sum())
    mean = None
    for seen, blob in zip(group["seen"], group["network"]):
        x = np.frombuffer(blob, "<f4") * np.float32(seen / total)
        mean = x if mean is None else mean + x
    return pd.DataFrame({"part": [int(group["part"].iloc[0])], "seen": [total], "network": [mean.astype("<f4").tobytes()]})


def texts_of_ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()]


def passes(n_windows: int) -> int:
    """How often training takes each window of a corpus."""
    return max(1, min(MOST_PASSES, -(-LEAST_WINDOWS // max(n_windows, 1))))


def train(tokens: DataFrame, start: Params, n_windows: int) -> Params:
    """The network after rounds over shares of the documents, that together hold each once."""
    spark = tokens.sparkSession
    draws = passes(n_windows)
    p, q, done = start, squares(start), 0
    schema = "part int, seen long, network binary"
    for r, share in enumerate(ROUNDS):
        rows = tokens.where(F.col("share").between(done, done + share - 1)).select("ids")
        done += share
        shared = spark.sparkContext.broadcast(pack(p, q))

        def run(batches: Iterator[pa.RecordBatch], r=r, shared=shared, like=start) -> Iterator[pa.RecordBatch]:
            mine, sums = unpack(shared.value, like)
            seen = descend(mine, sums, map(texts_of_ids, batches), draws, 1000 * r)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([seen]), pa.array([pack(mine, sums)], pa.binary())], names=["part", "seen", "network"])

        parts = rows.rdd.getNumPartitions()
        trained = map_arrow(rows, run, schema).withColumn("part", F.spark_partition_id())
        while parts > 1:
            parts = -(-parts // FAN_IN)
            trained = trained.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInPandas(_average, schema)
        found = trained.collect()  # one network
        if found:
            p, q = unpack(bytes(found[0]["network"]), start)
        shared.unpersist()
    return p


def score(p: Params, texts: list[np.ndarray]) -> np.ndarray:
    """The sum of the log-probabilities of each text's tokens, in blocks of windows."""
    total, tables = np.zeros(len(texts)), weighted(p)
    ends = np.cumsum([len(t) for t in texts])
    # Some texts at a time; a long one by itself.
    parts = np.flatnonzero(np.r_[True, np.diff(ends // LAID_OUT) > 0, True]) if len(texts) else np.empty(0, np.int64)
    for i, j in zip(parts[:-1], parts[1:]):
        flat, at = laid_out(texts[i:j])
        found = np.empty(len(at), np.float32)
        for a in range(0, len(at), BLOCK):
            found[a : a + BLOCK] = log_probabilities(p, *windows(flat, at[a : a + BLOCK]), tables)
        some = np.flatnonzero([len(t) for t in texts[i:j]])
        if len(some):
            begin = ends[i:j][some] - [len(texts[i + k]) for k in some] - (ends[i] - len(texts[i]))
            total[i + some] = np.add.reduceat(found, begin, dtype=np.float64)
    return total


def scored(tokens: DataFrame, p: Params) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(p)  # the network, whose size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of_ids(batch)
            n = np.array([len(t) for t in texts], np.int64)
            total = batch.column("spelled").to_numpy() + (score(shared.value, texts) if n.any() else 0.0)
            mean = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total), mean], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return map_arrow(tokens.select("doc_id", "ids", "spelled"), run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def fitted(docs: DataFrame) -> tuple[dict[str, int], Spelling, Params, DataFrame]:
    """The vocabulary, the spelling model and the network of all documents, and the documents as tokens."""
    counts = word_counts(docs)
    known = frequent_words(counts)
    vocab = tokens_of(known)
    spelling = spelling_of(counts, docs.sparkSession.createDataFrame([(w,) for w, _ in known], "word string"))
    n_windows = counts.agg(F.sum("n")).first()[0] or 0
    discard(counts)
    tokens = encoded(docs, vocab, spelling)
    start = initial([n for _, n in known], n_windows - sum(n for _, n in known))
    return vocab, spelling, train(tokens, start, n_windows), tokens


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_likelihood (the sum over all its tokens) and its mean a token.

    A null or empty text has 0 tokens, the sum 0 and a null mean. Null ids and repeated rows are scored like others; each
    repeated row counts in training. Long texts are scored whole, in blocks of windows. Words of equal counts enter the
    vocabulary in the order of their letters. Further columns are not read. An empty table gives an empty result.
    """
    _, _, p, tokens = fitted(docs)
    return scored(tokens, p)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
