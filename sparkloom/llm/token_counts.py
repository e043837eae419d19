"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change is an insert (+ new count), a delete (- old count) or a revision (- old + new). A batch of changes folds into
signed sums by (source, lang, version) and is committed under its batch id: its sums replace whatever was committed under
that id before, so a batch that is sent again, or is rerun after a failure, counts once. Totals are kept: they are
additive, so the batches since the last folding are added to them, and folded in from time to time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .common import cut, discard, map_arrow, shared_path, table
from .tokens import default_ranks, token_ids

KEYS = ("source", "lang", "version")
CHANGES = "op string, source string, lang string, version string, old_tokens long, new_tokens long"
SUMS = "source string, lang string, version string, documents long, tokens long"
WORD = re.compile(r"\S+")


def count_tokens(text: str | None, version: str) -> int:
    """Tokens of a text under a tokenizer version; a null text counts as empty."""
    if not text:
        return 0
    return len(WORD.findall(text)) if version == "words_v1" else len(token_ids(text, default_ranks()))


#: Tokenizer versions that count_tokens knows.
VERSIONS = ("words_v1", "byte_bpe_50k")


def _count(versions: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("old_text", "new_text")]
            for version in versions:
                columns = [batch.column(n) for n in names]
                for side in ("old_text", "new_text"):
                    texts = batch.column(side).to_pylist()
                    columns.append(pa.array([None if t is None else count_tokens(t, version) for t in texts], pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([version] * batch.num_rows)], names=[*names, "old_tokens", "new_tokens", "version"])

    return run


def counted(changes: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """Changes (op, source, lang, old_text, new_text) with the counts of both texts, one row for each tokenizer version."""
    rows = changes.select("op", "source", "lang", "old_text", "new_text")
    found = map_arrow(rows, _count(versions), "op string, source string, lang string, old_tokens long, new_tokens long, version string")
    return found.select("op", "source", "lang", "version", "old_tokens", "new_tokens")


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch of changes (CHANGES): documents and tokens by source, language and version.

    Inserts without a new count and deletes without an old one change the documents and no tokens; other ops change
    nothing. Null sources, languages and versions are keys like others. Partial sums meet in the shuffle, so a source with
    most of the rows costs no more than others.
    """
    old, new = F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    documents = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -old).when(F.col("op") == "revise", new - old)
    return (
        changes.groupBy(*KEYS)
        .agg(F.coalesce(F.sum(documents), F.lit(0)).alias("documents"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
        .select(*KEYS, F.col("documents").cast("long").alias("documents"), F.col("tokens").cast("long").alias("tokens"))
    )


class Rollup:
    """Committed batches and kept totals in a folder that the cluster shares.

    A manifest names what is in force: the table of totals, the batches folded into it, and the recent batches since, each
    with its sums and what it changes (its sums, less those that a folded batch of its id had). A commit writes the sums,
    then the next manifest, which comes into being whole, so readers see the rollup as it was or as it is, and a crash before
    that leaves what was. Of two commits at a time the slower one starts its manifest again from the other's. From
    MOST_RECENT batches on they are folded: the totals take their changes in, and their sums join the folded ones, in
    tables of doubling sizes. So totals read one table and a bounded number of batches, and a manifest stays small.
    """

    MOST_RECENT = 16

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("manifests").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def manifest(self) -> tuple[int, dict]:
        """The number of the manifest in force and what it names: totals (a folder or None), folded (level and folder of
        each table) and recent (by batch id, the folders of its sums and of what it changes)."""
        folder = self._at("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((int(n) for n in names if n.isdigit()), default=0)
        if not last:
            return 0, {"totals": None, "folded": [], "recent": {}}
        stream = self._fs.open(self._at(f"manifests/{last:012d}"))
        try:
            return last, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, number: int, state: dict) -> bool:
        """Whether the manifest of this number is ours now; no other is written over."""
        draft, final = self._at(f"manifests/draft-{uuid.uuid4().hex}"), self._at(f"manifests/{number:012d}")
        stream = self._fs.create(draft)
        stream.write(json.dumps(state).encode())
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False

    def _write(self, rows: DataFrame) -> str:
        folder = f"sums/{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, folders: list[str]) -> DataFrame:
        schema = f"batch_id string, {SUMS}"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, batch_id: str, sums: DataFrame) -> None:
        """Puts a batch's delta in place of the one committed under this id before; a rerun leaves the same totals."""
        # A row without keys and sums stands for the batch itself, also where nothing is left of it.
        own = self.spark.createDataFrame([(batch_id, None, None, None, 0, 0)], f"batch_id string, {SUMS}")
        folder = self._write(own.unionByName(sums.select(F.lit(batch_id).alias("batch_id"), *KEYS, "documents", "tokens")))
        while True:
            number, state = self.manifest()
            changes, before = folder, self._folded(state["folded"]).where(F.col("batch_id") == batch_id)
            if state["folded"] and not before.isEmpty():
                less = before.select("batch_id", *KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))
                changes = self._write(self._read([folder]).unionByName(less))
            if self._publish(number + 1, state | {"recent": state["recent"] | {batch_id: [folder, changes]}}):
                break
        if len(state["recent"]) + 1 >= self.MOST_RECENT:
            self.fold()

    def _folded(self, tables: list) -> DataFrame:
        """The sums of the batches of some folded tables, the newest first; of one id those of the newest table."""
        out = self._read([f for _, f in tables[:1]])
        for k in range(1, len(tables)):
            newer = self._read([f for _, f in tables[:k]]).select("batch_id").distinct()
            out = out.unionByName(self._read([tables[k][1]]).join(newer, "batch_id", "left_anti").select(*out.columns))
        return out

    def fold(self) -> bool:
        """Takes the recent batches into the totals; False if there are none or another commit came in between."""
        number, state = self.manifest()
        if not state["recent"]:
            return False
        totals = self._write(self._totals(state).select(F.lit(None).cast("string").alias("batch_id"), *KEYS, "documents", "tokens"))
        folded = [[0, self._write(self._read([sums for sums, _ in state["recent"].values()]))], *state["folded"]]
        while len(folded) > 1 and folded[0][0] == folded[1][0]:
            folded = [[folded[0][0] + 1, self._write(self._folded(folded[:2]))], *folded[2:]]
        return self._publish(number + 1, {"totals": totals, "folded": folded, "recent": {}})

    def batches(self) -> DataFrame:
        """batch_id and its sums; empty before the first commit. For audits: it reads all batches there are."""
        _, state = self.manifest()
        out = self._read([sums for sums, _ in state["recent"].values()])
        if state["folded"]:
            older = self._folded(state["folded"]).join(out.select("batch_id").distinct(), "batch_id", "left_anti")
            out = out.unionByName(older.select(*out.columns))
        return out.where("documents <> 0 OR tokens <> 0 OR coalesce(source, lang, version) IS NOT NULL")

    def _totals(self, state: dict) -> DataFrame:
        changes = self._read([*([state["totals"]] if state["totals"] else []), *(c for _, c in state["recent"].values())])
        sums = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version; keys whose documents and tokens are all gone are left out."""
        return self._totals(self.manifest()[1])

    def vacuum(self) -> None:
        """Deletes the writes and manifests that are no longer in force; for times without readers or commits."""
        number, state = self.manifest()
        used = [state["totals"], *(f for _, f in state["folded"]), *(f for both in state["recent"].values() for f in both)]
        keep = {f.split("/")[1] for f in used if f} | {f"{number:012d}"}
        for name in ("sums", "manifests"):
            for f in self._fs.listStatus(self._at(name)) if self._fs.exists(self._at(name)) else ():
                if f.getPath().getName() not in keep:
                    self._fs.delete(f.getPath(), True)


def redacted(text):
    """A text without e-mail addresses and with single spaces, for revisions."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\w.+-]+@[\w-]+\.[\w.]+", ""), r"[ \t]+", " "))


def _feed(spark: SparkSession, sf_dir: str, versions: tuple[str, ...]) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    labels = labels.where("toxic = 1 OR quality = 0").withColumnRenamed("doc_id", "_id")
    empty = F.lit(None).cast("string")
    inserts = docs.select(F.lit("insert").alias("op"), "source", "lang", empty.alias("old_text"), F.coalesce("text", F.lit("")).alias("new_text"))
    later = docs.join(labels.hint("shuffle_hash"), docs.doc_id == labels["_id"]).select(
        F.when(F.col("toxic") == 1, "delete").otherwise("revise").alias("op"),
        "source",
        "lang",
        F.coalesce("text", F.lit("")).alias("old_text"),
        F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 0, redacted(F.coalesce("text", F.lit("")))).alias("new_text"),
    )
    first = counted(inserts, versions)
    return totals_of(spark, [("0", first), ("1", counted(later, versions)), ("0", first)])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, those labelled toxic deleted and those labelled of low quality revised (redacted).

    The first batch is sent twice. The result is the totals. A null text counts as empty, a long one whole; rows that repeat
    are inserted, deleted and revised each; documents without id keep what was inserted; an empty table gives no rows.
    """
    return _feed(spark, sf_dir, VERSIONS)


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the tokenizer version that SQL can count."""
    return _feed(spark, sf_dir, ("words_v1",))


WORDS_SQL = r"""
WITH l AS (SELECT doc_id, coalesce(max(toxic), 0) = 1 AS gone FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(toxic) = 1 OR min(quality) = 0),
d AS (
  SELECT source, lang, coalesce(text, '') AS t, l.doc_id IS NOT NULL AS hit, coalesce(gone, false) AS gone,
    trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\w.+-]+@[\w-]+\.[\w.]+', '', 'g'), '[ \t]+', ' ', 'g')) AS clean
  FROM documents LEFT JOIN l USING (doc_id)
)
SELECT source, lang, 'words_v1' AS version, sum(CASE WHEN gone THEN 0 ELSE 1 END)::BIGINT AS documents,
  sum(CASE WHEN gone THEN 0 WHEN hit THEN len(regexp_extract_all(clean, '\S+')) ELSE len(regexp_extract_all(t, '\S+')) END)::BIGINT AS tokens
FROM d GROUP BY source, lang HAVING sum(CASE WHEN gone THEN 0 ELSE 1 END) <> 0
"""


def totals_of(spark: SparkSession, feed: list[tuple[str, DataFrame]]) -> DataFrame:
    """Commits the batches (id, changes) in order, in a rollup of their own, and returns the totals.

    A batch that is sent again is summed once. Null sources, languages and versions are keys like others; no changes give no
    totals.
    """
    rollup = Rollup(spark, shared_path(spark, "token-counts"))
    sums: dict[int, DataFrame] = {}
    for batch_id, changes in feed:
        if id(changes) not in sums:
            sums[id(changes)] = cut(delta(changes))
        rollup.commit(batch_id, sums[id(changes)])
    discard(*sums.values())
    return rollup.totals()
