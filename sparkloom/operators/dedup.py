"""Removal of exact and of similar rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Observation, Window

from ..arrow import map_arrow
from ..functions.similarity import CONTAINED, LENGTH_RATIO, close_pairs
from ..sources.scratch import cut, discard

#: Letters of the grams that find texts of few edits, and of those that find texts within others.
EDIT_GRAM = 2
PART_GRAM = 3
_EDGE = "\u0001"
#: Texts and letters of a chunk, two of which are compared by tokens at a time; the first of a chunk that may be split for more tasks.
CHUNK = 1 << 17
CHUNK_LETTERS = 1 << 22
CHUNK_LEAST = 1 << 12


def drop_exact(df: DataFrame, order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row of each group equal in ``columns`` (default: all but ``order``), nulls being equal; the first by ``order``.

    The first row is found by a minimum with partial aggregation, so a large group costs no more than others.
    """
    keys = columns or [c for c in df.columns if c != order]
    if order is None:
        return df.dropDuplicates(keys)
    others = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(F.col(f"`{order}`"), *(F.col(f"`{c}`") for c in others))).alias("_first")
    kept = df.groupBy(*(F.col(f"`{c}`") for c in keys)).agg(first)
    return kept.select(*(F.col(f"`{c}`") if c in keys else F.col("_first").getField(c).alias(c) for c in df.columns))


def plain(c: Column) -> Column:
    return F.lower(F.trim(c))


def text_score(a: Column, b: Column) -> Column:
    """1 for equal texts, at least CONTAINED if one contains the other, else the Levenshtein similarity."""
    x, y = plain(a), plain(b)
    short, long = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y), F.lit(1))
    contained = F.contains(x, y) | F.contains(y, x)
    return F.when(x == y, 1.0).when(contained, F.greatest(F.lit(CONTAINED), short / long)).otherwise(1.0 - F.levenshtein(x, y) / long)


def joined_keys(df: DataFrame, keys: list[str]) -> Column:
    return F.concat_ws(" | ", *(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys))


def _lengths_fit(x: str = "x", y: str = "y") -> Column:
    return F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y)) >= LENGTH_RATIO


def _edit_candidates(texts: DataFrame, threshold: float) -> DataFrame:
    """k, t, u (t < u) of texts that few enough edits may lie between.

    Of texts at most d edits apart, all but EDIT_GRAM * d of the longer one's grams (with their edges, each numbered by its
    occurrence) are shared. In any one order of all grams, the first EDIT_GRAM * d + 1 grams of either text then have one in
    common. The order is by frequency, so that rare grams meet.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("p") + 1), lambda i: F.substring(F.concat(F.lit(_EDGE), F.col("p"), F.lit(_EDGE)), i, F.lit(EDIT_GRAM)))
    counted = texts.select("k", "t", "p", F.explode(grams).alias("g")).groupBy("k", "t", "p", "g").agg(F.count(F.lit(1)).alias("n"))
    each = cut(counted.select("k", "t", F.length("p").alias("size"), "g", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("o")))
    ranks = each.groupBy("g", "o").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("k", "t").orderBy("df", "g", "o"))
    edits = F.floor(F.col("size") * ((1 - threshold) / threshold) + 1e-9)
    first = cut(each.join(ranks, ["g", "o"]).withColumn("place", place).where(F.col("place") <= EDIT_GRAM * edits + 1).select("k", "g", "o", "t", "size"))
    other = first.select("k", "g", "o", F.col("t").alias("u"), F.col("size").alias("size2"))
    near = (F.col("t") < F.col("u")) & (F.least("size", "size2") >= threshold * F.greatest("size", "size2") - 1e-9)
    return first.join(other, ["k", "g", "o"]).where(near).select("k", "t", "u")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, t, u and score of the close texts of each group of two chunks, or of one with itself."""
    for batch in batches:
        for k, one, two, least in zip(*(batch.column(c) for c in ("k", "one", "two", "least"))):
            sides = [x.values for x in (one, two) if x.is_valid]
            texts = [x.field("p").to_pylist() for x in sides]
            sizes = np.concatenate([x.field("size").to_numpy() for x in sides])
            found = close_pairs(texts[0], texts[1] if len(texts) > 1 else None, least.as_py(), sizes)
            i, j = (np.array([r[c] for r in found], np.int64) for c in (0, 1))
            x, y = sizes[i], sizes[j + (len(texts[0]) if len(texts) > 1 else 0)]
            fits = np.minimum(x, y) / np.maximum(x, y) >= LENGTH_RATIO
            scores = np.array([r[2] for r in found], float)[fits]
            columns = [pa.repeat(k, len(scores)), sides[0].field("t").take(pa.array(i[fits])), sides[-1].field("t").take(pa.array(j[fits])), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "t", "u", "score"])


def _token_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """k, t, u (t < u) and score of texts whose token_score reaches the threshold.

    All texts of a block meet, in groups of two chunks of about CHUNK texts and CHUNK_LETTERS letters, or of twice as many at
    most. Texts of the same words are in one chunk, as long as it holds them. A group is one row.
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    n, letters = F.count(F.lit(1)), F.sum(F.length("p"))
    # Chunks that would be few for the cores are smaller.
    more = F.least(F.ceil(n / CHUNK_LEAST), F.lit(math.ceil(math.sqrt(4 * cores))))
    # Small tables are written, as Spark then knows that they are small and doesn't deal all texts of a block to one task.
    sized = cut(texts.groupBy("k").agg(F.greatest(F.ceil(n / CHUNK), F.ceil(letters / CHUNK_LETTERS), more, F.lit(1)).alias("m")))
    words = F.xxhash64(F.array_sort(F.split("p", " ")))
    dealt = texts.join(sized, "k").select("k", "t", "p", F.length("x").alias("size"), F.pmod(words, "m").alias("c"))
    pieces = dealt.groupBy("k", "c").agg(F.greatest(F.ceil(n / (2 * CHUNK)), F.ceil(letters / (2 * CHUNK_LETTERS)), F.lit(1)).cast("int").alias("pieces"))
    block = Window.partitionBy("k")
    before = F.sum("pieces").over(block.orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    pieces = cut(pieces.select("k", "c", "pieces", F.coalesce(before, F.lit(0)).cast("int").alias("first"), F.sum("pieces").over(block).cast("int").alias("m")))
    # A chunk, and even more a group, takes long, so there are several times as many parts, that few get two.
    sums = F.sum("pieces").cast("long"), F.sum(F.expr("pieces * (m + 1L) / 2")).cast("long")
    chunk_parts, parts = (max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(8 * (x or 1), 32 * cores)) for x in pieces.agg(*sums).first())
    number = F.col("first") + F.pmod(F.xxhash64("t"), "pieces").cast("int")
    placed = dealt.join(pieces, ["k", "c"]).select("k", number.alias("c"), "m", F.struct("t", "p", "size").alias("row"))
    chunks = cut(placed.repartition(chunk_parts, "k", "c").groupBy("k", "c", "m").agg(F.collect_list("row").alias("rows")))
    lower = chunks.select("k", F.col("c").alias("i"), F.explode(F.sequence("c", F.col("m") - 1)).alias("j"), F.col("rows").alias("one"))
    upper = chunks.where("c > 0").select("k", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i"), F.col("c").alias("j"), F.col("rows").alias("two"))
    both = lower.repartition(parts, "k", "i", "j").join(upper.repartition(parts, "k", "i", "j"), ["k", "i", "j"], "left")
    # A chunk without rows has no partner; a group of a chunk with itself has none either.
    groups = both.where("i = j OR two IS NOT NULL").select("k", "one", "two", F.lit(threshold).alias("least"))
    kinds = dict(texts.dtypes)
    found = map_arrow(groups, _close, f"k {kinds['k']}, t {kinds['t']}, u {kinds['t']}, score double")
    return found.select("k", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"), "score")


def _part_candidates(texts: DataFrame) -> DataFrame:
    """k, t, u (t < u) of texts of which one may hold the other: the rarest gram of the shorter is one of the longer's."""

    def grams(n: int) -> Column:
        starts = F.when(F.length("p") >= n, F.sequence(F.lit(1), F.greatest(F.length("p") - n + 1, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.array_distinct(F.transform(starts, lambda i: F.substring("p", i, F.lit(n))))

    # Texts shorter than a gram are looked up by their own length, in texts that are not too long for them.
    short = texts.where(F.length("p") < PART_GRAM).agg(F.max(F.length("x"))).first()[0] or 0
    few = F.concat(*(grams(n) for n in range(1, PART_GRAM)))
    own = F.concat(grams(PART_GRAM), F.when(F.length("x") <= short / LENGTH_RATIO, few).otherwise(F.expr("cast(array() as array<string>)")))
    posted = cut(texts.select("k", F.col("t").alias("u"), F.col("x").alias("y"), F.explode(own).alias("g")))
    df = posted.groupBy("k", "g").agg(F.count(F.lit(1)).alias("df"))
    mine = F.when(F.length("p") >= PART_GRAM, grams(PART_GRAM)).otherwise(F.array("p"))
    rarest = texts.select("k", "t", "x", F.explode(mine).alias("g")).join(df, ["k", "g"]).groupBy("k", "t", "x").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    found = rarest.join(posted, ["k", "g"]).where((F.col("t") != F.col("u")) & _lengths_fit())
    return found.select("k", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))


def similar_texts(texts: DataFrame, threshold: float, mode: str = "edits") -> DataFrame:
    """k, t, u and score of different texts x of (k, t, x), t being the key of a text in block k.

    The score is text_score, or with ``mode="tokens"`` similarity.token_score, which needs a threshold of two thirds or more.
    """
    if mode not in ("edits", "tokens") or (mode == "tokens" and not 2 / 3 <= threshold <= 1):
        raise ValueError("mode is edits, or tokens with a threshold from two thirds to 1")
    texts = texts.withColumn("p", plain(F.col("x")))
    if mode == "tokens":
        return _token_pairs(texts, threshold)
    if threshold < 0.5:
        # Grams prove nothing for so many edits: all texts of fitting lengths are compared.
        sized = texts.withColumn("bucket", F.floor(F.log(F.length("x").cast("double")) / F.log(F.lit(1 / LENGTH_RATIO))))
        other = sized.select("k", F.col("t").alias("u"), F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))).alias("bucket"))
        pairs = sized.select("k", "t", "bucket").join(other, ["k", "bucket"]).where("t < u").select("k", "t", "u")
    else:
        pairs = _edit_candidates(texts, threshold)
        if threshold <= CONTAINED:
            pairs = pairs.unionByName(_part_candidates(texts))
    pairs = pairs.distinct()
    both = pairs.join(texts.select("k", "t", "x", "p"), ["k", "t"]).join(texts.select("k", F.col("t").alias("u"), F.col("x").alias("y"), F.col("p").alias("q")), ["k", "u"])
    long = F.greatest(F.length("p"), F.length("q"), F.lit(1))
    edits = F.expr(f"levenshtein(p, q, cast(floor({1 - threshold} * greatest(length(p), length(q), 1) + 1e-9) as int))")
    contained = F.contains("p", F.col("q")) | F.contains("q", F.col("p"))
    part = F.greatest(F.lit(CONTAINED), F.least(F.length("p"), F.length("q")) / long)
    score = F.when(F.col("p") == F.col("q"), 1.0).when(contained, part).otherwise(F.when(edits >= 0, 1.0 - edits / long))
    scored = both.where(_lengths_fit()).select("k", "t", "u", score.alias("score"))
    return scored.where(F.col("score") >= threshold)


def _texts(df: DataFrame, keys: list[str], order: str, block: Column | None) -> tuple[DataFrame, DataFrame]:
    """Rows (a, x, k) whose joined keys aren't blank, and the distinct texts (k, t, x), t being the first row's ``order``."""
    rows = df.select(F.col(f"`{order}`").alias("a"), joined_keys(df, keys).alias("x"), (block if block is not None else F.lit("")).alias("k"))
    rows = rows.where((F.trim("x") != "") & F.col("k").isNotNull())
    return rows, rows.groupBy("k", "x").agg(F.min("a").alias("t"))


def similar_pairs(df: DataFrame, keys: list[str], order: str, threshold: float = 0.85, block: Column | None = None, mode: str = "edits") -> DataFrame:
    """a < b (by ``order``) and score of the rows whose joined keys are similar, within blocks (a null block has no pairs).

    Only different texts are compared, and of those the ones that grams can't rule out. Rows are paired by their texts last.
    """
    rows, texts = _texts(df, keys, order, block)
    texts = cut(texts)
    alike = similar_texts(texts, threshold, mode)
    # Pairs are turned round in place, as a union of both ways would find them twice.
    ways = F.array(F.struct("t", "u"), F.struct(F.col("u").alias("t"), F.col("t").alias("u")))
    alike = alike.select("k", F.inline(ways), "score").unionByName(texts.select("k", "t", F.col("t").alias("u"), F.lit(1.0).alias("score")))
    placed = rows.join(texts, ["k", "x"]).select("k", "t", "a")
    pairs = placed.join(alike, ["k", "t"]).join(placed.select("k", F.col("t").alias("u"), F.col("a").alias("b")), ["k", "u"])
    return pairs.where("a < b").select("a", "b", "score")


def greedy_drops(pairs: DataFrame) -> DataFrame:
    """The rows that go when each row, in order, removes the later ones it is similar to unless it is removed itself.

    In each round a row without an undecided smaller partner is kept, and its partners go; rounds follow until all are
    decided. Each round's state is written to the shared folder.
    """
    left = cut(pairs.select("a", "b").distinct())
    gone = pairs.select("b").limit(0)
    while not left.isEmpty():
        later = left.select(F.col("b").alias("a")).distinct()
        kept = left.select("a").distinct().join(later, "a", "left_anti")
        lost = cut(left.join(kept, "a", "left_semi").select("b").distinct())
        gone = gone.unionByName(lost)
        decided = lost.withColumnRenamed("b", "a")
        before, left = left, cut(left.join(kept, "a", "left_anti").join(decided, "a", "left_anti").join(lost, "b", "left_anti"))
        discard(before)
    return gone


def drop_similar(df: DataFrame, keys: list[str], order: str, threshold: float = 0.85, block: Column | None = None, mode: str = "edits") -> DataFrame:
    """Without the rows that an earlier one that stays is similar to; rows of blank keys or a null block stay.

    Rows of equal texts share their fate but for the first, so the decision is made on different texts.
    """
    rows, texts = _texts(df, keys, order, block)
    texts = cut(texts)
    pairs = similar_texts(texts, threshold, mode).select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"))
    gone = greedy_drops(pairs).withColumnRenamed("b", "a")
    kept = texts.select(F.col("t").alias("a")).join(gone, "a", "left_anti")
    lost = rows.select("a").join(kept, "a", "left_anti").select(F.col("a").alias("_gone"))
    return df.join(lost, F.col(f"`{order}`") == F.col("_gone"), "left_anti")


def dedup_report(df: DataFrame, order: str, keys: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """One row: initial_rows, exact_duplicates_removed, fuzzy_duplicates_removed and final_rows of drop_exact and drop_similar.

    ``df`` is computed once: its rows are counted before and after in the pass that removes equal ones.
    """
    before, after, n = Observation(), Observation(), F.count(F.lit(1)).alias("n")
    exact = cut(drop_exact(df.observe(before, n), order).observe(after, n))
    counts = [before.get["n"], after.get["n"]]
    counts.append(drop_similar(exact, keys, order, threshold).count() if keys else counts[1])
    discard(exact)
    row = (counts[0], counts[0] - counts[1], counts[1] - counts[2], counts[2])
    return df.sparkSession.createDataFrame([row], "initial_rows long, exact_duplicates_removed long, fuzzy_duplicates_removed long, final_rows long")
