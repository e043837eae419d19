"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Words and their shapes (case, digits, symbols) hash into buckets, weighted by log counts and by inverse document
frequencies over all documents. A truncated singular value decomposition of a bounded sample of labelled rows gives the
latent space. The labelled vectors are broadcast; every document is projected, its cosines with all of them are computed
exactly, block by block, and the nearest ones vote with weights that grow with their similarity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import free_name, map_arrow, table, texts_of

BUCKETS = 1 << 13
#: Dimensions of the latent space.
RANK = 64
#: Labelled rows of each class that the model is fitted on at most; their vectors are all of them that the driver holds.
LABELLED_PER_CLASS = 1000
NEIGHBOURS = 15
#: Exponent of a neighbour's cosine in its weight.
SHARPNESS = 4
#: A document is kept from this score on.
KEEP_FROM = 0.3
#: Name of the added column, unless the input has one of that name.
SCORE = "_quality_score"
#: Documents whose cosines are computed at a time.
BLOCK = 512
#: Words whose buckets a worker remembers.
HELD_WORDS = 300_000

_RUNS = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class WordBuckets(dict):
    """Word to the buckets of the word (A-Z lower-cased) and of its shape, as one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        shape = word
        for run, letter in _RUNS:
            shape = run.sub(letter, shape)
        half = BUCKETS // 2
        value = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) % half) * half + xxhash.xxh3_64_intdigest(shape) % half
        return value


#: Weight of the words against that of the shapes.
WORD_SHARE = 0.3
#: Bucket of a word that repeats the one before it.
AGAIN = BUCKETS - 1


def term_counts(text: bytes, cache: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text: words in the lower half, shapes and words that repeat the one before in the upper."""
    words = text.split()
    both = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    half = BUCKETS // 2
    again = np.full(np.count_nonzero(both[1:] == both[:-1]), AGAIN, np.int64)
    return np.unique(np.concatenate([both // half, both % half + half, again]), return_counts=True)


def weights(buckets: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times inverse document frequencies, words and shapes each of unit length, then scaled by WORD_SHARE."""
    w = (np.log1p(n) * idf[buckets]).astype(np.float32)
    upper = buckets >= BUCKETS // 2
    for part, share in ((~upper, WORD_SHARE), (upper, 1 - WORD_SHARE)):
        w[part] *= share / max(float(np.linalg.norm(w[part])), 1e-12)
    return w


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, df, n = WordBuckets(), np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in texts_of(batch):
            df[term_counts(text, cache)[0]] += 1
            n += 1
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, seen], pa.int32()), pa.array(np.r_[n, df[seen]], pa.int64())], names=["bucket", "n"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all documents have each bucket, and how many documents there are; at most BUCKETS + 1 rows."""
    rows = map_arrow(docs.select("text"), _document_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, np.int64)
    total = 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, total


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors of documents in the latent space (zero for a text without words)."""
        out = np.zeros((len(counts), self.projection.shape[1]), np.float32)
        for i, (buckets, n) in enumerate(counts):
            if len(buckets):
                out[i] = weights(buckets, n, self.idf) @ self.projection[buckets]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity; 0 where nothing is near."""
        if not len(self.labels):
            return np.zeros(len(vectors))
        cosines = np.maximum(vectors @ self.vectors.T, 0)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cosines, near, 1).astype(np.float64) ** SHARPNESS
        return (weight * self.labels[near]).sum(1) / np.maximum(weight.sum(1), 1e-12)


def fit(texts: list[bytes], labels: list[int], df: np.ndarray, total: int, rank: int = RANK) -> Model:
    """The latent space and the labelled vectors of a bounded list of texts."""
    idf = np.log((1 + total) / (1 + df))
    cache = WordBuckets()
    counts = [term_counts(t, cache) for t in texts]
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for i, (buckets, n) in enumerate(counts):
        x[i, buckets] = weights(buckets, n, idf)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    values, vectors = np.linalg.eigh((x @ x.T).astype(np.float64))
    top = [i for i in np.argsort(-values)[:rank] if values[i] > 1e-9]
    projection = (x.T @ (vectors[:, top] / np.sqrt(values[top])).astype(np.float32)) if top else np.zeros((BUCKETS, 1), np.float32)
    model = Model(idf, projection, np.zeros((0, projection.shape[1]), np.float32), np.array(labels, np.float64))
    return Model(idf, projection, model.project(counts), model.labels)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves remainder 0 by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_rows(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> DataFrame:
    """Rows (doc_id, text, quality): of each class the ``per_class`` training rows whose hashed ids come first."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    chosen = None
    for quality in (0, 1):
        part = known.where(F.col("quality") == quality).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.withColumnRenamed("doc_id", "_id")  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == chosen["_id"])
    # Of documents that share an id the text that comes first counts, so that the bound holds.
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> list:
    """The rows of labelled_rows by their ids."""
    return labelled_rows(docs, labels, per_class).orderBy("doc_id").collect()


def _fit(df: np.ndarray, total: int):
    """Fits all rows of a partition; a row with the latent space and the labelled vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += texts_of(batch)
            known += batch.column("quality").to_pylist()
        if texts:
            m = fit(texts, known, df, total)
            parts = [m.projection.astype("<f4").tobytes(), m.vectors.astype("<f4").tobytes(), m.labels.astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([m.projection.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], names=["rank", "projection", "vectors", "labels"])

    return run


def train(docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS) -> Model:
    """The model of the labelled rows, fitted in a task, so that the driver holds neither their texts nor their matrix."""
    df, total = document_frequencies(docs)
    rows = labelled_rows(docs, labels, per_class).repartition(1).sortWithinPartitions("doc_id")
    found = map_arrow(rows.select("text", "quality"), _fit(df, total), "rank int, projection binary, vectors binary, labels binary").first()
    if found is None:
        return fit([], [], df, total)
    projection, vectors = (np.frombuffer(found[c], "<f4").reshape(-1, found["rank"]) for c in ("projection", "vectors"))
    return Model(np.log((1 + total) / (1 + df)), projection, vectors, np.frombuffer(found["labels"], "<f8"))


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """Adds the score as a column that ``docs`` doesn't have; its columns pass through, and a text without words scores 0."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by BUCKETS * RANK and the sample
    at, n = docs.columns.index("text"), len(docs.columns)
    plain = docs.toDF(*map(str, range(n)))  # names with dots and the like can't pass through Arrow stages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordBuckets()
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                texts = pa.RecordBatch.from_arrays([part.column(at)], names=["text"])
                scores = shared.value.vote(shared.value.project([term_counts(t, cache) for t in texts_of(texts)]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*docs.columns, name)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from KEEP_FROM on).

    Null and empty texts score 0; long texts are read whole. Only ``doc_id`` and ``text`` are read, and of ``labels`` the
    quality of rows that are not held out (a null id counts as held out). Of several labels for a document the larger counts,
    of labelled rows that share an id the text that comes first. Of labelled texts that are equally near any may vote.
    Without labels all score 0. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "text")
    scored = with_scores(rows, train(rows, labels), SCORE).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= KEEP_FROM).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score KEEP_FROM or more, with their columns of any name.

    Each row is judged by its own whole text, whatever its id, so null and repeated ids and repeated rows stay or go by their
    texts. Null and empty texts, and others without words, score 0 and go; without usable labels all do. A score of exactly
    KEEP_FROM stays. An empty table gives an empty result.
    """
    name = free_name(docs, SCORE)
    return with_scores(docs, train(docs, labels), name).where(F.col(name) >= KEEP_FROM).select(*(f"`{c}`" for c in docs.columns))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
