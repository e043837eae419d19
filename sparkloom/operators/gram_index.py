"""Substring search by an index of trigrams that is kept beside the rows.

Every text that holds a term holds all of the term's trigrams. The index lists the rows of each trigram, so a search reads
the lists of the term's rarest trigrams, what is in all of them is looked up, and only those rows are tested for the term.
Lists are rows of a table, dealt by the trigram's hash and sorted by it, so no trigram's list meets in one task, and a search
reads the folders and the stretches of its trigrams alone. Rows lie in folders by the hash of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from ..arrow import map_arrow
from ..functions.casts import text
from ..sources.readers import with_row_id
from ..sources.scratch import cut
from .search import matches, term_of

GRAM = 3
#: Lists of so many of a term's trigrams, the rarest, are intersected; the others hardly rule out more.
LISTS = 4
NUMBER, PART = "_number", "_part"


def _folder(c: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(folders)).cast("int")


def grams(value: str) -> set[str]:
    return {value[i : i + GRAM] for i in range(len(value) - GRAM + 1)}


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            some = batch.slice(begin, 1000)
            numbers, found = [], []
            for number, values in zip(some.column(NUMBER).to_pylist(), some.column("values").to_pylist()):
                of = set().union(*(grams(v) for v in values if v is not None))
                numbers.extend([number] * len(of))
                found.extend(of)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(numbers, pa.int64())], names=["gram", NUMBER])


class GramIndex:
    """Rows and the lists of their trigrams under a path of a store that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 64):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders

    def build(self, df: DataFrame) -> GramIndex:
        """Writes both tables; columns named _number or _part are not allowed, all others are searched as texts."""
        if {NUMBER, PART} & {c.lower() for c in df.columns}:
            raise ValueError(f"columns named {NUMBER} and {PART} are the index's own")
        rows = cut(with_row_id(df, NUMBER).withColumn(PART, _folder(F.col(NUMBER), self.folders)))
        self._write(rows.repartition(PART), PART, "rows")
        dtypes = dict(df.dtypes)
        values = F.array(*(F.lower(text(F.col(f"`{c}`"), dtypes[c])) for c in df.columns))
        lists = map_arrow(rows.select(NUMBER, values.alias("values")), _listed, f"gram string, {NUMBER} long")
        lists = lists.withColumn("folder", _folder(F.col("gram"), self.folders))
        # By ranges, so that a trigram of many rows is dealt to several tasks.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(lists.repartitionByRange(n, "folder", "gram", NUMBER).sortWithinPartitions("folder", "gram"), "folder", "lists")
        return self

    def _write(self, df: DataFrame, folder: str, name: str) -> None:
        """A table in folders, and its schema beside it, which an empty one wouldn't tell."""
        df.write.mode("overwrite").partitionBy(folder).parquet(f"{self.path}/{name}")
        df.limit(0).write.mode("overwrite").parquet(f"{self.path}/{name}.schema")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/{name}.schema").schema).parquet(f"{self.path}/{name}")

    def lists(self, found: set[str]) -> DataFrame:
        """gram and number of the rows of some trigrams; the folders of others aren't read."""
        asked = sorted(found)
        by_hash = self.spark.createDataFrame([(g,) for g in asked], "gram string").select(_folder(F.col("gram"), self.folders).alias("folder")).distinct()
        folders = sorted(r["folder"] for r in by_hash.collect())  # of the term's trigrams
        return self._read("lists").where(F.col("folder").isin(folders) & F.col("gram").isin(asked)).select("gram", NUMBER)

    def candidates(self, term: str) -> DataFrame | None:
        """Numbers and folders of the rows that hold all of the rarest trigrams of a term; None for a term without any."""
        asked = grams(term.lower())
        if not asked:
            return None
        sizes = {r["gram"]: r["n"] for r in self.lists(asked).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
        rarest = sorted(asked, key=lambda g: (sizes.get(g, 0), g))[:LISTS]
        if sizes.get(rarest[0], 0) == 0:
            return self.lists({rarest[0]}).select(NUMBER, F.lit(0).alias(PART)).limit(0)
        out = self.lists({rarest[0]}).select(NUMBER)
        for g in rarest[1:]:
            out = out.join(self.lists({g}).select(NUMBER), NUMBER, "left_semi")
        return out.withColumn(PART, _folder(F.col(NUMBER), self.folders))

    def search(self, query: dict | None = None, strict: bool = False) -> DataFrame:
        """What search.search gives for the rows: those that match, with ``_score``.

        A term of fewer letters than a trigram is looked for in all rows, and an empty one matches all.
        """
        rows, term = self._read("rows"), term_of(query, strict)
        columns = [c for c in rows.columns if c not in (NUMBER, PART)]
        if not term:
            return rows.select(*(F.col(f"`{c}`") for c in columns), F.lit(1.0).alias("_score"))
        found = self.candidates(term)
        if found is not None:
            rows = rows.join(found, [NUMBER, PART], "left_semi")
        rows = rows.select(*(F.col(f"`{c}`") for c in columns))
        return rows.withColumn("_score", matches(rows, term).cast("double")).where("_score > 0")
