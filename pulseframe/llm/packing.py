"""Packing documents into fixed-length token sequences by their length histogram.

1. Each text is tokenized once; its ids and an end id are cut into pieces of at most
   ``size`` tokens (whole sequences from the start, then the rest). Only the pieces' numbers
   go on: start, length, CRC-32 of the ids.
2. The histogram of piece lengths (at most ``size`` rows, whatever the corpus) is packed on the
   driver, shortest pack first: lengths are placed longest first, each into the packs with the
   least content that still have room; equal packs are one pattern with a count, and a count
   is split when only some of them are used.
3. Patterns go back to pieces by rank: the r-th piece of a length takes the r-th slot for it.

Scale: tokens never leave the task that made them; what is shuffled is a few numbers a piece.
Ranks inside a length are built from counts per hash slice, so a length that a third of all
pieces share is ranked in many tasks. The slots sent to all tasks number at most two patterns
per length times the lengths in a pattern, 2 * size * sqrt(2 * size): a bound by ``size``, not
by the corpus. A word cache per worker holds at most twice ``CACHE_WORDS`` short chunks.
(Checked to give the tokenizer's own ids on whole texts; little-endian machines only.)

Defined results: a NULL or blank text is its end id alone; repeated rows are packed each; ids
may be NULL; offsets in a sequence are gapless from 0; an empty table gives no rows; only the
id column of the input is carried.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from pulseframe.llm.common import written

SIZE = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE_WORDS = 300_000
CACHE_BYTES = 48  # longest chunk that is remembered
# Chunks that need no whole tokenizer call: Latin letters up to U+024F, which NFC leaves alone
# (without the one whose lower case ends in a mark), and one mark after them. All others go to
# the tokenizer as they are.
LATIN = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
PLAIN = re.compile(f"([{LATIN}]+)([.,!?;:]?)")
SLICES = 64


class WordIds(dict):
    """Little-endian ids of a white-space-free chunk of UTF-8, by the tokenizer, remembered.

    Valid for tokenizers that normalise to lower-case NFC, drop white space, never join what it
    separates, and take a run of letters as one word of byte-level pieces and a mark after it as
    another. Words of Latin letters go straight to the merge model, once for all their cases.
    Chunks of more than ``CACHE_BYTES`` are not remembered, and of the others the last
    ``CACHE_WORDS`` and as many before them, so the memory is bounded; what comes up again
    moves to the front and is not made twice.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[bytes, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = str.maketrans({b: chr(256 + i) for i, b in enumerate(hidden)})

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.made(chunk)
        if len(chunk) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def made(self, chunk: bytes) -> bytes:
        word = chunk.decode()
        plain = PLAIN.fullmatch(word)
        if not plain:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if plain[2]:
            return self[plain[1].encode()] + self[plain[2].encode()]
        small = word.lower()
        if small != word and PLAIN.fullmatch(small):
            return self[small.encode()]
        pieces = self.model.tokenize(small.encode().decode("latin-1").translate(self.bytes))
        return array("I", [p.id for p in pieces]).tobytes()

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""


@cache
def encoder(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): the pieces of every document."""
    path = path or public_tokenizers.path(TOKENIZER)
    kind = docs.schema[doc_id].dataType
    numbers = ["start", "length", "ids_crc32", "doc_tokens"]
    schema = StructType([StructField(doc_id, kind), *[StructField(n, LongType()) for n in numbers]])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(1)):
                ids = words.text(t.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append(i)
                    out.append((start, len(part) // 4, zlib.crc32(part), total))
            columns = [pa.array([o[k] for o in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], [doc_id, *numbers])

    return docs.select(doc_id, text).mapInArrow(cut, schema)


Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> dict[Pattern, int]:
    """How many sequences have each pattern. At most two patterns are made per length and room."""
    open_: dict[int, list[list]] = {}  # room -> [pattern, count]
    done: dict[Pattern, int] = {}

    def put(pattern: Pattern, room: int, n: int) -> None:
        if room:
            open_.setdefault(room, []).append([pattern, n])
        else:
            done[pattern] = done.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                put(((length, 1),), size - length, left)
                break
            entry = open_[room][-1]
            pattern, n = entry
            # one more of this length in min(n, left) of these packs; or several at once if all get them
            times = max(1, min(left // n, room // length)) if left >= n else 1
            used = min(n, left)
            if used == n:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                entry[1] = n - used
            times = _times(times, room, length, open_)
            put((*pattern, (length, times)) if pattern[-1][0] != length else (*pattern[:-1], (length, pattern[-1][1] + times)), room - times * length, used)
            left -= used * times
    for room in open_.values():
        for pattern, n in room:
            done[pattern] = done.get(pattern, 0) + n
    return done


def _times(times: int, room: int, length: int, open_: dict) -> int:
    """Copies placed at once: as long as the pack stays the shortest one."""
    other = max(open_, default=0)
    return max(1, min(times, (room - other) // length + 1))


def slots(patterns: dict[Pattern, int]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, sequences, first sequence, first offset), by first rank.

    A row stands for ``k`` copies in each of its sequences; its ranks are sequences * k.
    """
    rows: dict[int, list] = {}
    base = 0
    ranks: dict[int, int] = {}
    for pattern in sorted(patterns):
        n, offset = patterns[pattern], 0
        for length, k in pattern:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, n, base, offset))
            ranks[length] = rank + n * k
            offset += length * k
        base += n
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def slice_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, "start", "ids_crc32", "line"), F.lit(SLICES * 16))


def ranked(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rank`` (from 0) of each piece among those of its length; ``line`` tells equal rows apart."""
    keyed = rows.withColumn("slice", slice_of(doc_id))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "slice").count()
    counts = counts.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slice").orderBy(doc_id, "start", "ids_crc32", "line")
    numbered = keyed.withColumn("n", F.row_number().over(within)).join(counts, ["length", "slice"])
    return numbered.select(*rows.columns, (F.col("before") + F.col("n") - 1).alias("rank"))


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, text, doc_id, size, end_id, path).withColumn("line", F.monotonically_increasing_id()), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))
    rows, names = ranked(cut, doc_id), [c for c in cut.columns if c != "line"]
    schema = StructType([*[cut.schema[c] for c in names], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    columns = schema.names

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                found = table.value[int(value)]
                row = found[np.searchsorted(found[:, 0], rank[at], "right") - 1]
                copy, which = np.divmod(rank[at] - row[:, 0], row[:, 1])
                sequence[at], offset[at] = row[:, 2] + which, row[:, 3] + copy * value
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], columns)

    return rows.mapInArrow(place, schema)
