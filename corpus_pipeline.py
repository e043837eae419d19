"""A corpus pipeline of five stages, each an operator of the text subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, exact_dedup, near_dedup, packing, quality
from sparkloom.llm.common import discard_since, mark, remove, shared_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it learns from the labelled rows among ``docs``.

    Null, empty and very long texts, ties, repeated rows and empty tables are as quality.keep_good says.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal documents: of null and empty texts, which are equal, the largest id stays, as of others.

    Ties, repeated rows and empty tables are as exact_dedup.drop_exact says.
    """
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates; null, empty and short texts stay, as near_dedup.keep_one says."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts stay, as decontamination.drop_leaks says."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences; null and empty texts are a separator each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training a classifier, sketches and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the shared folder and read again.

    A stage's input, and the tables that it wrote on its way, are deleted when its result is there.
    """
    out, docs, before = shared_path(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        discard_since(spark, at)
        if before:
            remove(spark, before)
        before = f"{out}/{name}"
        docs = spark.read.parquet(before)
    return docs
