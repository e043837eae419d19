"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text's words (letters and digits, lower-cased) give runs of five, each labelled with how often it occurred before in the
text, so that all are distinct. Each of HASHES sketches takes the two labelled runs whose hashes are smallest and keeps
them in text order, so a sketch agrees only if the runs and their order do. Two sketches make a band; texts with an equal
band are candidates, and so are linked if verification finds a similarity of at least 0.8: the length of the longest common
subsequence of their labelled runs within a band around the diagonal, against all runs of either. A match cannot lie
further off the diagonal than the runs that 0.8 leaves unmatched, so the band loses nothing.

Texts with equal words are one class from the start. Every class is first aligned with the hubs of its buckets, the members
that a bucket's most frequent sketch values are of; that links most of what can be linked with one pair a member. What is
left of a bucket with several components is joined exactly: its largest component and the free members, those in others,
go in blocks, and every pair of a free member with another block or its own meets in one group of rows. There common runs are
counted by an inverted list, which bounds the similarity from above, and pairs that could reach 0.8 and aren't connected yet
are aligned. A group gives a spanning set of links, so rows grow with members and not with pairs. In buckets with more free
members than a block, rounds of further hubs come before, as long as they link. Which member is a hub changes the work only.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import cut, free_name, map_arrow, settled, table
from .url_filter import connected_components

WORDS = 5
SIMILAR_FROM = 0.8
#: Order MinHash sketches of a text; pairs of them are the bands.
HASHES = 32
BANDS = HASHES // 2
#: Members in a block of a bucket; a text counts once more for each LONG_TEXT runs, which bounds what a task holds of a block.
LARGE_BUCKET = 2000
LONG_TEXT = 2000
#: Occurrences of runs that are counted at a time for one text.
HELD_HITS = 1 << 21
#: Share of the free members in large buckets that a further round of hubs must link for another one to follow.
ROUND_LINKS = 0.1
WORD = re.compile(r"[^\W_]+")
#: Hash values that are held at a time for one text.
HELD_VALUES = 1 << 20
#: Distinct words whose hashes a worker remembers.
HELD_WORDS = 300_000
_SEEDS = np.random.default_rng(20240601).integers(1, 1 << 63, (HASHES, 2), dtype=np.uint64) | np.uint64(1)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def labelled_runs(text: str | None, cache: WordHashes) -> np.ndarray:
    """64-bit hashes of the runs in text order, each with its occurrence; a text of fewer words is one run, one without none."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += each[i : i + n]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return h
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def order_sketches(runs: np.ndarray) -> np.ndarray:
    """For each hash function the two smallest runs in text order, as one 32-bit value."""
    if len(runs) == 1:
        runs = np.repeat(runs, 2)
    base = runs ^ (runs >> np.uint64(31))
    out = np.empty(HASHES, np.uint32)
    step = max(1, HELD_VALUES // len(runs))
    for k in range(0, HASHES, step):
        h = base * _SEEDS[k : k + step, :1] + _SEEDS[k : k + step, 1:]
        h ^= h >> np.uint64(32)
        two = runs[np.sort(np.argpartition(h, 1, axis=1)[:, :2], axis=1)]
        out[k : k + step] = mix(two[:, 0] * np.uint64(0x9E3779B97F4A7C15) + two[:, 1]) >> np.uint64(32)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Longest common subsequence of labelled runs near the diagonal, as a share of all runs of either text."""
    if not len(a) or not len(b):
        return 0.0
    _, at, bt = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = int((1 - SIMILAR_FROM) * max(len(a), len(b))) + 1
    near = np.abs(at - bt) <= band
    at, bt = at[near], bt[near]
    if len(at) < SIMILAR_FROM * max(len(a), len(b)):
        return len(at) / (len(a) + len(b) - len(at))
    bt = bt[np.argsort(at)]
    if np.all(bt[1:] > bt[:-1]):
        common = len(bt)
    else:
        tails: list[int] = []
        for x in bt.tolist():
            i = bisect.bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        common = len(tails)
    return common / (len(a) + len(b) - common)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        keys, sizes, sketches = [], [], []
        for text in batch.column("text").to_pylist():
            runs = labelled_runs(text, cache)
            sizes.append(len(runs))
            keys.append(xxhash.xxh3_128_digest(runs.tobytes()) if len(runs) else None)
            sketches.append(order_sketches(runs).astype("<u4").tobytes() if len(runs) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
            names=["doc_id", "key", "n_runs", "sketch"],
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        runs = [labelled_runs(t, cache).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(runs, pa.binary())], names=["rep", "runs"])


def links_of(rep: np.ndarray, label: np.ndarray, side: np.ndarray, within: bool, runs: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what similarity connects: of side 1 with side 0, and if ``within`` with side 1 as well."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    _, token = np.unique(np.concatenate(runs), return_inverse=True)
    order = np.argsort(token, kind="stable")
    owner = np.repeat(np.arange(len(runs)), sizes)[order]
    first = np.cumsum(np.r_[0, np.bincount(token)])
    start = np.cumsum(np.r_[0, sizes])
    out = []
    for x in np.flatnonzero(side == 1):
        mine = token[start[x] : start[x + 1]]
        n = first[mine + 1] - first[mine]
        common = np.zeros(len(runs), np.int64)
        # In steps, so that a long text with frequent runs doesn't hold all of their occurrences at once.
        steps = np.cumsum(n) // HELD_HITS
        edges = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1], True])
        for begin, end in zip(edges[:-1], edges[1:]):
            m = n[begin:end]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[mine[begin:end]], m)
            common += np.bincount(owner[at], minlength=len(runs))
        could = (common >= SIMILAR_FROM * (sizes[x] + sizes - common) - 1e-9) & (label != label[x])
        could &= (side == 0) | (within & (np.arange(len(runs)) < x))
        for y in np.flatnonzero(could):
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q and similarity(runs[x], runs[y]) >= SIMILAR_FROM:
                parent[max(p, q)] = min(p, q)
                out.append((min(int(rep[x]), int(rep[y])), max(int(rep[x]), int(rep[y]))))
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups of two blocks; the rows of a group follow each other, and the last group of a batch may go on."""
    last, held = None, []

    def links() -> pa.RecordBatch:
        rep, label, side, within, runs = zip(*held)
        found = links_of(np.array(rep), np.array(label), np.array(side), within[0], [np.frombuffer(r, np.uint64) for r in runs])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("band", "i", "j", "rep", "label", "side", "within", "runs")]
        for band, i, j, *row in zip(*columns):
            if held and last != (band, i, j):
                yield links()
                held = []
            last = (band, i, j)
            held.append(row)
    if held:
        yield links()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        last, runs, good = None, None, []
        for a, x, y in zip(batch.column("hub").to_pylist(), batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
            if a != last:
                last, runs = a, labelled_runs(x, cache)
            good.append(similarity(runs, labelled_runs(y, cache)) >= SIMILAR_FROM)
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("hub").filter(keep), batch.column("rep").filter(keep)], names=["a", "b"])


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (hub, rep) of doc_ids with both texts. The pairs are hashed, the texts stream past."""
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where("_id IS NOT NULL")
    one = texts.join(pairs.hint("shuffle_hash"), texts["_id"] == pairs.hub).select("hub", "rep", F.col("text").alias("text_a"))
    return texts.join(one.hint("shuffle_hash"), texts["_id"] == one.rep).select("hub", "rep", "text_a", F.col("text").alias("text_b"))


def with_hubs(members: DataFrame) -> DataFrame:
    """Each bucket's members with its hub: band, rep, hub, n.

    A bucket's own hub is the member nearest to its most frequent sketch values: copies of one text differ from it less
    than from each other, and the frequent values are that text's. Of the own hubs of its buckets each member prefers the
    one it agrees with most, and a bucket takes the hub that most of its members prefer, so that buckets which the copied
    text itself isn't in are compared with it too. Modes and hubs come from aggregates with partial sums.
    """
    values = F.transform(
        F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.conv(F.hex(F.substring("sketch", 4 * i + 1, F.lit(4))), 16, 10).cast("long")
    )
    split = cut(members.select("band", "rep", "n", values.alias("v")))

    def agreement(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda total, one: total + one)

    # Counts of values, so that no task holds all values of a bucket; the count goes above the value's 32 bits.
    counts = split.select("band", F.posexplode("v").alias("i", "x")).groupBy("band", "i", "x").agg(F.count(F.lit(1)).alias("k"))
    tops = counts.groupBy("band", "i").agg(F.max(F.shiftleft("k", 32) + F.col("x")).alias("top"))
    modes = tops.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("i", F.col("top").bitwiseAND((1 << 32) - 1).alias("x")))).alias("m"))
    modes = modes.select("band", F.col("m.x").alias("modes"))
    own = split.join(modes, "band").groupBy("band").agg(F.max_by(F.struct("rep", "v"), F.struct(agreement("v", "modes"), -F.col("rep"))).alias("own"))
    seen = split.join(own, "band").select("band", "rep", "n", F.col("own.rep").alias("own"), agreement("v", "own.v").alias("agree"))
    best = seen.groupBy("rep").agg(F.max_by("own", F.struct("agree", -F.col("own"))).alias("best"))
    seen = cut(seen.join(best, "rep").select("band", "rep", "n", "best"))
    hubs = seen.groupBy("band", "best").agg(F.count(F.lit(1)).alias("k")).groupBy("band").agg(F.max_by("best", F.struct("k", -F.col("best"))).alias("hub"))
    return seen.join(hubs, "band").select("band", "rep", "hub", "n")


def labelled(members: DataFrame, links: DataFrame, weights: DataFrame) -> DataFrame:
    """(band, rep) of the buckets with several components: band, rep, label, main, n_main, n_free.

    ``main`` tells the members of the bucket's largest component; the others are free. Their numbers are sums of the
    ``weights`` (rep, w).
    """
    labels = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("label"))
    known = weights.join(labels, "rep", "left").select("rep", "w", F.coalesce("label", "rep").alias("label"))
    marked = cut(members.select("band", "rep").join(known, "rep"))
    sizes = marked.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"))
    several = sizes.groupBy("band").agg(F.max(F.struct("k", "label", "w")).alias("top"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    several = several.select("band", F.col("top.label").alias("top"), F.col("top.w").alias("n_main"), (F.col("n") - F.col("top.w")).alias("n_free"))
    return cut(marked.join(several, "band").select("band", "rep", "label", (F.col("label") == F.col("top")).alias("main"), "n_main", "n_free"))


def hub_links(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of members (band, rep, hub) with their hubs."""
    pairs = members.where("rep <> hub").select("hub", "rep").distinct()
    return map_arrow(with_texts(pairs, rows), _verify, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_blocks(members: DataFrame) -> DataFrame:
    """Rows of ``labelled`` for each group of two blocks that they are in: band, i, j, rep, label, side, within.

    Group (i, j) has block i of the main component as side 0 and block j of the free members as side 1; ``within`` is set for
    i = 0 only, so that the pairs within j are compared once. Group (-1 - i, j) has the free blocks i < j.
    """
    blocks = lambda n: F.ceil(F.col(n) / LARGE_BUCKET).cast("int")
    group = lambda i, j, side, within: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"), within.alias("within"))
    a, f, own, no = F.col("_a"), F.col("_f"), F.col("_own"), F.lit(False)
    span = lambda lo, hi: F.filter(F.sequence(lo, F.greatest(lo, hi)), lambda x: x <= hi)
    of_main = F.transform(span(F.lit(0), f - 1), lambda j: group(own, j, 0, own == 0))
    of_free = F.concat(
        F.transform(span(F.lit(0), a - 1), lambda i: group(i, own, 1, i == 0)),
        F.transform(span(F.lit(0), own - 1), lambda i: group(-1 - i, own, 1, no)),
        F.transform(span(own + 1, f - 1), lambda j: group(-1 - own, j, 0, no)),
    )
    placed = members.select("*", blocks("n_main").alias("_a"), blocks("n_free").alias("_f"))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), a).otherwise(f)).cast("int"))
    placed = placed.select("band", "rep", "label", F.explode(F.when(F.col("main"), of_main).otherwise(of_free)).alias("g"))
    return placed.select("band", "g.i", "g.j", "rep", "label", "g.side", "g.within")


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_runs of near_classes."""
    sketched = cut(map_arrow(rows, _sketch, "doc_id long, key binary, n_runs int, sketch binary"))
    known = sketched.where("doc_id IS NOT NULL AND key IS NOT NULL")
    weight = 1 + F.floor(F.max("n_runs") / LONG_TEXT)
    reps = cut(known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch"), weight.alias("w")))
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 8 * i + 1, 8)) for i in range(BANDS)))
    members = reps.select("rep", F.explode(bands).alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sketches, weights = reps.select("rep", "sketch"), reps.groupBy("rep").agg(F.max("w").alias("w"))
    members = settled(lambda: with_hubs(members.join(shared, "band").join(sketches, "rep")))
    links = cut(hub_links(members, rows))
    # The hubs have met all of their buckets.
    members = members.where("rep <> hub").select("band", "rep")
    open_rows = labelled(members, links, weights)
    last = None
    while True:
        large = open_rows.where(~F.col("main") & (F.col("n_free") > LARGE_BUCKET))
        left = large.count()
        if not left or (last is not None and left > (1 - ROUND_LINKS) * last):
            break
        again = with_hubs(large.select("band", "rep", F.col("n_free").alias("n")).join(sketches, "rep"))
        links, last = cut(links.unionByName(hub_links(again, rows)).distinct()), left
        open_rows = labelled(members, links, weights)
    wanted = open_rows.select(F.col("rep").alias("_rep")).distinct()
    texts = rows.join(wanted.hint("shuffle_hash"), rows["doc_id"] == wanted["_rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text")
    runs = cut(map_arrow(texts, _runs, "rep long, runs binary").distinct())
    dealt = in_blocks(open_rows).join(runs, "rep").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "rep")
    links = cut(links.unionByName(map_arrow(dealt, _links, "a long, b long")).distinct())
    labels = connected_components(links, "a", "b").select(F.col("node").alias("_rep"), F.col("component").alias("_class"))
    degree = links.select(F.col("a").alias("x")).unionByName(links.select(F.col("b").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("n_links"))
    classes = reps.join(labels, reps.rep == labels["_rep"], "left").join(degree, reps.rep == degree.x, "left")
    classes = classes.select(F.col("key").alias("_key"), F.coalesce("_class", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (
        sketched.join(classes, (sketched["key"] == classes["_key"]) & sketched["doc_id"].isNotNull(), "left").select(
            "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_runs"
        )
    )


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of the class), class_size, n_links, n_runs.

    A class is a connected component of links between texts; texts with equal words are linked. Texts are read whole.
    ``n_links`` counts the links found between a document's words and other words (a spanning set of them, not all pairs).
    Texts without words and rows without doc_id are classes of their own. Rows repeated with the same doc_id count once in
    ``class_size`` for each row; of documents that share their words the smallest doc_id stands for all. An empty table gives
    an empty result. Further columns of ``docs`` are not read.
    """
    placed = settled(lambda: _classes(docs.select("doc_id", "text")))
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).where("class_size > 1").withColumnRenamed("class_id", "_c")
    return placed.join(sizes, placed.class_id == sizes["_c"], "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "n_links", "n_runs"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, with their columns of any name; rows without id stay.

    Texts too short for a run of words, null and empty ones included, are near none and stay. Rows of one id share their
    fate, so repeated rows stay or go together. Long texts are compared whole. An empty table gives an empty result.
    """
    key = free_name(docs, "_gone_id")
    gone = near_classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == F.col(key), "left_anti")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, int]:
    """doc_id to class by aligning all pairs; for tests."""
    cache = WordHashes()
    runs = [(d, labelled_runs(t, cache)) for d, t in sorted(docs)]
    parent = {d: d for d, _ in runs}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (d, x) in enumerate(runs):
        for e, y in runs[:i]:
            if min(len(x), len(y)) >= SIMILAR_FROM * max(len(x), len(y)) and similarity(x, y) >= SIMILAR_FROM:
                p, q = sorted((root(d), root(e)))
                parent[q] = p
    return {d: root(d) for d, _ in runs}


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
