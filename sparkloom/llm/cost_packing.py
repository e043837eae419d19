"""Packing into sequences of equal attention cost and length, with nothing left to pad.

The cost of a piece of l tokens is estimated as LINEAR * l + l * l: the layers' work on each token, and attention within
the piece. From the longest item down, each goes to the sequence of lowest cost that has room for it; an item that no
sequence has room for is cut at the largest room, and its end is an item again. The sequences have as many places as
there are tokens: full ones, and for the rest one sequence for each binary digit, as those of a power of two aren't padded.

Lengths are whole numbers up to the capacity, so all this is planned on the histogram of lengths, for many equal items
and sequences at a time: the plan's steps depend on how many lengths there are, not on how many documents. Spark then
numbers the items of each length, and the plan tells where each number's pieces go.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from .common import cut, map_arrow, table

CAPACITY = 2048
SEPARATOR_ID = 1
#: Six times the width of the model: the share of a layer's work that grows with the tokens, where attention counts one.
LINEAR = 6 * 1024
#: Rows of one length that one task numbers, about, and the least parts of a length: full pieces hold most of the bytes.
ROWS_PER_SALT, LEAST_SALTS = 20_000, 512
#: Words that aren't plain whose ids a worker keeps, and their longest.
KEPT, KEPT_LENGTH = 200_000, 32


def cost(length: int) -> int:
    """The estimated cost of a piece."""
    return LINEAR * length + length * length


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (size, first, n, start, length, sequence, offset) for items counted by size (1 to capacity).

    The items of that size numbered from ``first`` on, ``n`` of them, give their tokens from ``start`` on, ``length`` of
    them, to as many sequences from ``sequence`` on, each at ``offset``. Every token of every item has one place, and
    all sequences are full: of ``capacity`` tokens, or of a power of two.
    """
    sizes = {size: n for size, n in histogram.items() if n > 0}
    full, rest = divmod(sum(size * n for size, n in sizes.items()), capacity)
    # Groups of sequences filled alike: (cost, first sequence, how many, used, room).
    groups = [(0, 0, full, 0, capacity)] if full else []
    for bit in range(rest.bit_length()):
        if rest >> bit & 1:
            groups.append((0, full, 1, 0, 1 << bit))
            full += 1
    # Those with room for the item at hand by their cost, the others by their room; items never grow.
    open_groups, tight = [], [(-g[4], g) for g in groups]
    heapq.heapify(tight)
    items = [(-size, size, 0, n, 0) for size, n in sizes.items()]
    heapq.heapify(items)
    rows = []
    while items:
        less, size, first, n, start = heapq.heappop(items)
        length = -less
        while n:
            while tight and -tight[0][0] >= length:
                heapq.heappush(open_groups, heapq.heappop(tight)[1])
            while open_groups and open_groups[0][4] < length:
                group = heapq.heappop(open_groups)
                heapq.heappush(tight, (-group[4], group))
            spent, sequence, count, used, room = heapq.heappop(open_groups) if open_groups else heapq.heappop(tight)[1]
            piece, m = min(length, room), min(n, count)
            rows.append((size, first, m, start, piece, sequence, used))
            if count > m:
                heapq.heappush(tight, (-room, (spent, sequence + m, count - m, used, room)))
            if room > piece:
                heapq.heappush(tight, (piece - room, (spent + cost(piece), sequence, m, used + piece, room - piece)))
            if length > piece:
                heapq.heappush(items, (piece - length, size, first, m, start + piece))
            first, n = first + m, n - m
    return rows


class Places:
    """The plan by size: where the numbers of a size begin to go other ways, and the pieces from there on."""

    def __init__(self, rows: list[tuple[int, int, int, int, int, int, int]]):
        by_size = defaultdict(list)
        for size, *row in rows:
            by_size[size].append(row)
        self.first, self.pieces = {}, {}
        for size, parts in by_size.items():
            parts.sort()
            edges = sorted({e for first, n, *_ in parts for e in (first, first + n)})
            held: list[list] = [[] for _ in edges]
            at = {e: i for i, e in enumerate(edges)}
            for first, n, start, length, sequence, offset in parts:
                for i in range(at[first], at[first + n]):
                    held[i].append((start, length, sequence - first, offset))
            self.first[size], self.pieces[size] = np.array(edges), held

    def of(self, size: int, number: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence less number, offset) of each piece of an item."""
        return self.pieces[size][int(np.searchsorted(self.first[size], number, "right")) - 1]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters that are whole in NFC, lower-cased one by one and classed alike by every version of Unicode.
PLAIN = re.compile(r"[\t-\r -~¡-¬®-ÿ]*")
WORD = re.compile(r"[^\t-\r ]+")
#: What a tokenizers file has to do for the way without the library; any other file's words go through the library.
STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])


def byte_letters() -> dict[str, int]:
    """The byte of each letter that a byte-level vocabulary writes: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PlainIds:
    """The ids of plain text: split by the file's pattern, then merged part by part in one call for the whole text.

    The vocabulary marks the letters that end a part. Here a space follows each part, and a letter with the space is what
    the vocabulary's marked letter is; such pairs come before all other merges, so the merges are the vocabulary's.
    """

    def __init__(self, file: dict):
        import tiktoken

        letters, mark, added = byte_letters(), file["model"]["end_of_word_suffix"], {t["content"] for t in file["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token.removesuffix(mark)) + (b" " if token.endswith(mark) else b""): rank
            for token, rank in file["model"]["vocab"].items()
            if token not in added
        }
        self.encode = tiktoken.Encoding("parts", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        of_kind = lambda k: "".join(re.escape(chr(c)) for c in range(33, 256) if unicodedata.category(chr(c))[0] == k)
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = re.compile(pattern.replace("\\p{L}", of_kind("L")).replace("\\p{N}", of_kind("N"))).findall

    def of(self, text: str) -> list[int]:
        parts = self.find(text.lower())
        return self.encode(" ".join(parts) + " ") if parts else []


class WordIds:
    """The ids of texts by a tokenizers file that drops white space, as bytes.

    The library takes 20 µs a word, most of it for normalizing and splitting. Texts of plain characters take a shorter way
    to the same ids; of others only the words that hold other characters go through the library, and it takes them once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        file = json.loads(self.tokenizer.to_str())
        steps, splits = (file["normalizer"] or {}).get("normalizers", []), (file["pre_tokenizer"] or {}).get("pretokenizers", [])
        known = ([s["type"] for s in steps], [s["type"] for s in splits]) == STEPS and file["model"]["end_of_word_suffix"]
        self.plain = PlainIds(file) if known else None
        self.added = tuple(t["content"] for t in file["added_tokens"])
        self.kept: dict[str, list[int]] = {}

    def is_plain(self, text: str) -> bool:
        return self.plain is not None and PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def word(self, word: str) -> list[int]:
        """A word that isn't plain."""
        found = self.kept.get(word)
        if found is None:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            if len(word) <= KEPT_LENGTH:
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                self.kept[word] = found
        return found

    def of(self, text: str) -> bytes:
        if self.is_plain(text):
            return np.array(self.plain.of(text), self.kind).tobytes()
        ids, run = [], []
        for word in WORD.findall(text):
            if self.is_plain(word):
                run.append(word)
            else:
                ids += self.plain.of(" ".join(run)) if run else []
                ids += self.word(word)
                run = []
        ids += self.plain.of(" ".join(run)) if run else []
        return np.array(ids, self.kind).tobytes()


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process and tokenizer."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _items(path: str, capacity: int, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end, width = np.array([separator], words.kind).tobytes(), words.kind.itemsize
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                columns: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = words.of(text or "") + end
                    total = len(ids) // width
                    for start in range(0, total, capacity):
                        piece = ids[width * start : width * (start + capacity)]
                        for column, value in zip(columns, (doc_id, start, len(piece) // width, total, piece)):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return run


def token_items(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR_ID) -> DataFrame:
    """doc_id, start, length (to ``capacity``), doc_tokens and ids of every document: its text's ids and a separator.

    The tokenizer must drop white space, so that a text's ids are those of its words one after another. A null or empty
    text is the separator alone. Ids are little-endian, of two bytes where the vocabulary allows it, else of four.
    Further columns of ``docs`` aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _items(tokenizer_path or default_tokenizer(), capacity, separator), "doc_id long, start long, length long, doc_tokens long, ids binary")


def _pieces(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "length", "doc_tokens", "ids")
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                columns: tuple[list, ...] = ([], [], [], [], [], [], [])
                lists = [batch.slice(begin, 1000).column(n).to_pylist() for n in (*names, "number")]
                for doc_id, start, size, total, ids, number in zip(*lists):
                    tokens = np.frombuffer(ids, f"<u{len(ids) // size}").astype("<u4")
                    for at, length, shift, offset in places.of(size, number):
                        row = (doc_id, start + at, length, total, tokens[at : at + length].tobytes(), number + shift, offset)
                        for column, value in zip(columns, row):
                            column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*names, "sequence_id", "offset"])

    return run


def pack_balanced(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every token of every document in a place of a sequence: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A row is a piece: ``length`` tokens of a document from ``start`` on, with their ids (little-endian unsigned 32-bit),
    at ``offset`` of a sequence. Sequences are filled without gaps, to ``capacity`` or to a power of two. Documents longer
    than the capacity are cut into full items first. A null or empty text is one separator; null or repeated doc_ids and
    repeated rows are documents of their own, told apart by their order only. Items of one length are numbered by doc_id
    (nulls first) and start, so ties go to either. An empty table gives an empty result. The items are written to the
    shared folder once; only the counts by length (at most ``capacity`` rows) reach the driver.
    """
    items = cut(token_items(docs, tokenizer_path, capacity))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Items of one length are numbered in salted parts, each from the count of the parts before it.
    salts = max(LEAST_SALTS, max(histogram.values(), default=0) // ROWS_PER_SALT)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    )
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start"))
    numbered = salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("own") - 1)
    found = numbered.select("doc_id", "start", "length", "doc_tokens", "ids", "number")
    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"
    return map_arrow(found, _pieces(Places(plan(histogram, capacity))), schema)


def op12_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_balanced(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
