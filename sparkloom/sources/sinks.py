"""Writers, and an index kept as tables: documents by id, a mapping beside them."""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Observation, SparkSession, Window

from ..functions.casts import free_name
from ..plans.cleaning import index_mapping
from ..schemas import SemanticType as T
from .readers import with_row_id
from .scratch import cut

#: Between an index's name and the version of the table that holds it.
_VERSION = "__v_"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines; with ``array`` the part files, one after another, are one array, with a record a line."""
    if not array:
        df.write.mode("overwrite").json(path)
        return
    at = free_name(df, "_at")
    rows = with_row_id(df, at)
    record = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})
    n = rows.count()
    line = F.concat(F.when(F.col(at) == 0, "[").otherwise(""), record, F.when(F.col(at) == n - 1, "]").otherwise(","))
    lines = rows.select(at, line.alias("value")) if n else df.sparkSession.createDataFrame([(0, "[]")], f"{at} long, value string")
    lines.repartitionByRange(at).sortWithinPartitions(at).select("value").write.mode("overwrite").text(path)


def write_excel(df: DataFrame, path: str, max_rows: int = 1_048_575) -> None:
    """A workbook of at most the rows that one sheet holds; needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise RuntimeError("writing Excel needs the package openpyxl") from e
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError("more rows than a sheet holds")
    df.toPandas().to_excel(path, index=False)


def documents(df: DataFrame, index: str, row_id: str) -> DataFrame:
    """_index, _id (row number from 1, as text) and _source (JSON; nulls stay as nulls)."""
    fields = [F.col(f"`{c}`") for c in df.columns if c != row_id]
    source = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.lit(index).alias("_index"), (F.col(row_id) + 1).cast("string").alias("_id"), source.alias("_source"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new documents, and the old ones whose ids they don't have."""
    return old.join(new.select("_id"), "_id", "left_anti").select(*new.columns).unionByName(new)


def parse_bulk(lines: DataFrame, order: str = "line_no", line: str = "line", index: str = "generic_dataset") -> DataFrame:
    """_index, _id and _source of a bulk text: an action line (index or create) and the next line that isn't blank, its source.

    A source may look like an action itself: of lines in a row that do, every other one is an action. Where one has no
    ``_index`` the document goes to ``index``, all in lower case; where it has no ``_id`` it gets the number of its pair of
    lines. Lines that are neither, and actions whose next line is no JSON, are left out. Lines are dealt by ranges of
    ``order`` (no two may be equal there); what a range needs of others, one row for each, is worked out from their edges.
    """
    text = lines.select(F.col(order).alias("at"), F.trim(F.regexp_replace(line, r"^[\s]+|[\s]+$", " ")).alias("line")).where("line <> ''")
    kind = F.json_object_keys("line")[0]
    meta = F.expr("get_json_object(line, concat('$.', json_object_keys(line)[0]))")
    action = F.when(kind.isin("index", "create") & F.json_object_keys(meta).isNotNull(), meta)
    parsed = text.select("at", F.struct("line", F.try_parse_json("line").isNotNull().alias("json")).alias("own"), action.alias("meta"))
    rows = cut(parsed.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    other = F.col("meta").isNull()
    edges = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(other, F.col("at"))).alias("last"), F.min_by("own", "at").alias("first"))
    tails = rows.join(F.broadcast(edges.select("part", "last")), "part").where("last IS NULL OR at > last").groupBy("part").agg(F.count(F.lit(1)).alias("tail"))
    by_part = Window.orderBy("part")
    edges = edges.join(tails, "part", "left").select("*", (F.sum("n").over(by_part) - F.col("n")).alias("start"), F.lead("first").over(by_part).alias("after"))
    ended = F.max(F.when(F.col("last").isNotNull(), F.col("start") + F.col("n") - F.coalesce("tail", F.lit(0)))).over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("part", "start", "after", (F.col("start") - F.coalesce(ended, F.lit(0))).alias("carried"))  # a row for each range
    within = Window.partitionBy("part").orderBy("at")
    rows = rows.select("*", F.sum(F.when(other, 1).otherwise(0)).over(within).alias("run"), F.row_number().over(within).alias("i"), F.lead("own").over(within).alias("next"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("part", "run").orderBy("at")))
    rows = rows.join(F.broadcast(edges), "part")
    # Where an action stands in its row of action-like lines; a run begins with a line that is none, but for the first.
    since = F.when(F.col("run") == 0, F.col("carried") + F.col("place")).otherwise(F.col("place") - 1)
    source = F.coalesce("next", "after")
    found = rows.where(F.col("meta").isNotNull() & (since % 2 == 1) & source["json"])
    name = F.lower(F.coalesce(F.get_json_object("meta", "$._index"), F.lit(index)))
    number = (F.floor((F.col("start") + F.col("i") - 1) / 2) + 1).cast("string")
    return found.select(name.alias("_index"), F.coalesce(F.get_json_object("meta", "$._id"), number).alias("_id"), source["line"].alias("_source"))


@dataclass
class LoadResult:
    """What became of a load: documents written and not, seconds, the mapping and a message."""

    indexed: int
    failed: int
    seconds: float
    mapping: dict
    message: str


def sql_text(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Index:
    """An index in the session's catalog: a view over a log of tables with documents, with its mapping as a property.

    A load writes its own documents into a table of their own, bucketed by id, and then puts the view over it in one
    statement, so readers see the index as it was or as it is. Of documents with one id the view shows that of the newest
    table; as all tables are bucketed alike, that takes no shuffle. A log of more than MOST_TABLES tables is written anew as one.
    Tables that the view has left stay until the next load, so that readers who began before can end.
    """

    MOST_TABLES = 8
    BUCKETS = 16

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = re.sub(r"\W", "_", name.strip().lower().replace(" ", "_"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _property(self, key: str, default: str) -> str:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()
        return next((r["value"] for r in rows if r["key"] == key), default)

    def mapping(self) -> dict:
        return json.loads(self._property("mapping", "{}"))

    def log(self) -> list[str]:
        """The tables that the view is over, the oldest first."""
        return json.loads(self._property("log", "[]")) if self.exists() else []

    def _tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.name}{_VERSION}")]

    def _drop(self, tables: list[str]) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def delete(self) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name}")
        self._drop(self._tables())

    def count(self) -> int:
        return self.spark.table(self.name).count()

    def _write(self, documents: DataFrame) -> str:
        table = f"{self.name}{_VERSION}{uuid.uuid4().hex}"
        documents.write.bucketBy(self.BUCKETS, "_id").saveAsTable(table)
        return table

    def _show(self, log: list[str], mapping: dict) -> None:
        parts = []
        for i, table in enumerate(log):
            newer = "".join(f" LEFT ANTI JOIN {t} ON {table}._id = {t}._id" for t in log[i + 1 :])
            parts.append(f"SELECT {table}._index, {table}._id, {table}._source FROM {table}{newer}")
        properties = f"'mapping' = {sql_text(json.dumps(mapping))}, 'log' = {sql_text(json.dumps(log))}"
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ({properties}) AS {' UNION ALL '.join(parts)}")

    def load(self, df: DataFrame, types: dict[str, T], row_id: str, overwrite: bool = True) -> LoadResult:
        """Writes the documents; without ``overwrite`` those of known ids are replaced and the others stay.

        ``df`` is computed once, and its documents are counted while they are written. Rows without an id fail.
        """
        began, log = time.time(), self.log()
        left = set(self._tables()) - set(log)
        counted = Observation()
        offered = documents(df, self.name, row_id).observe(counted, F.count(F.lit(1)).alias("offered"), F.count("_id").alias("indexed"))
        table = self._write(offered.where(F.col("_id").isNotNull()))
        mapping = index_mapping(types)
        new = [table] if overwrite else [*log, table]
        self._show(new, mapping)
        if len(new) > self.MOST_TABLES:
            self._show([self._write(self.spark.table(self.name))], mapping)
        self._drop(sorted(left))
        n, written = counted.get["offered"], counted.get["indexed"]
        seconds = round(time.time() - began, 3)
        return LoadResult(written, n - written, seconds, mapping, f"{written} of {n} documents are in {self.name} after {seconds:.2f} s")


def indices(spark: SparkSession) -> DataFrame:
    """Names and numbers of documents of all indexes of the session's catalog."""
    names = [t.name for t in spark.catalog.listTables() if t.tableType == "VIEW" and not t.isTemporary]
    out = spark.createDataFrame([], "index string, docs long")
    for name in names:
        if {"_index", "_id", "_source"} <= set(spark.table(name).columns):
            out = out.unionByName(spark.table(name).agg(F.count(F.lit(1)).alias("docs")).select(F.lit(name).alias("index"), "docs"))
    return out
