"""Interpolated modified Kneser-Ney n-gram scores of whole texts.

Tokens are the words of a text (A-Z lower-cased) and one end; the first word follows a begin.
With c the count of an n-gram, T and N1, N2, N3 the sum of counts and the numbers of words
counted once, twice and more often after a context,

    p(w | context) = (c - D(c)) / T + (D1 N1 + D2 N2 + D3 N3) / T * p(w | shorter context)

where the highest order has counts of occurrences, each lower one the number of different
words before the n-gram (n-grams that follow the begin keep their occurrences), the discounts
D come from the counts of counts of their order, and the last shorter context is uniform over
the known words and one unknown.

1. Words are counted in Spark; their hashes and counts are stored as sorted arrays.
2. n-grams are counted as tuples of word hashes: each task combines what it reads, sorts it
   by first word and sends it to the shard of that word (a word of ``hot`` and more tokens is
   spread over all shards by the whole n-gram, so no word's successors meet in one task). The
   task that owns a shard sums it, stores sorted hashes and counts, and passes on the sums of
   its contexts and the counts of the next lower order.
3. Workers memory-map the arrays and look up the distinct n-grams of some million tokens at a
   time, in sorted order; per text only the sums leave.

Scale: everything counted grows with the corpus and lies in shards of some ``shard_bytes`` of
text each; a task holds one shard, the driver a handful of sums. The arrays stay in the shared
folder, which workers must see as a mounted path (``file:``): pages come and go with the
system's cache. Array files are written under another name and renamed, so a task that runs
twice leaves the same file. Words and n-grams are their 64-bit hashes.

Defined results: NULL and blank texts are one end; without training texts every score is
0 (one unknown word of probability one); repeated rows are each scored, and trained on;
``perplexity`` is per token; other columns pass through unless a result has their name; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pulseframe.llm.common import written
from pulseframe.session import scratch

ORDER = 2
SHARD_BYTES = 9_000_000  # of text whose n-grams one shard holds, some 1.5 million tokens
HOT = 500_000  # tokens of a word whose n-grams are spread over all shards
WORD_SHARDS = 4  # shards of n-grams for each shard of words
COMBINED = 2_000_000  # tokens that a task combines before it sends
STEP = 1_000_000  # tokens scored at once
PIECE = 2_000_000  # bytes of a text split into words at once
BATCH = 50_000  # rows of an Arrow batch
SEED = 42
END, BEGIN = b"", b" "  # no word is empty, and none holds a blank
GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


BEGIN_HASH = word_hash(BEGIN)


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in parts, the end after the last."""
    data = text.encode("utf-8", "surrogatepass").lower() if text else b""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end
    yield [END]


@dataclass
class Chunk:
    """Some tokens in order: their numbers, places in their text and rows, and the hash of each number (the last one the begin's).

    The first ``carried`` tokens belong to the chunk before and are there as history only.
    """

    ids: np.ndarray
    depth: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    carried: int


class Chunks:
    """Cuts the tokens of texts, also of very long ones, into chunks of some ``limit`` tokens."""

    def __init__(self, limit: int, order: int):
        self.limit, self.order = limit, order
        self.carry: tuple[list[bytes], int, int] = ([], 0, 0)  # words, place of the first, row
        self._open()

    def _open(self) -> None:
        self.number = defaultdict(count().__next__)
        words, depth, row = self.carry
        self.size = len(words)
        self.parts = [(self._ids(words), depth, row)] if words else []
        self.carried = len(words)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def add(self, row: int, text: str | None) -> Iterator[Chunk]:
        depth, last = 0, []
        for words in _pieces(text):
            self.parts.append((self._ids(words), depth, row))
            self.size += len(words)
            depth += len(words)
            last = [*last, *words][-(self.order - 1) :] if self.order > 1 else []
            if self.size >= self.limit:
                self.carry = ([], 0, 0) if words == [END] else (last, depth - len(last), row)
                yield self.close()
        self.carry = ([], 0, 0)

    def close(self) -> Chunk:
        """What is left as a chunk."""
        ids = np.concatenate([p[0] for p in self.parts])
        sizes = [len(p[0]) for p in self.parts]
        depth = np.concatenate([np.arange(d, d + n) for n, (_, d, _) in zip(sizes, self.parts)])
        row = np.repeat([p[2] for p in self.parts], sizes)
        hashes = np.fromiter(map(word_hash, [*self.number, BEGIN]), np.uint64, len(self.number) + 1)
        done = Chunk(ids, depth, row, hashes, self.carried)
        self._open()
        return done


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def key_of(words: list[np.ndarray]) -> np.ndarray:
    """One hash for each n-gram; a single word is its own."""
    key = words[0]
    for w in words[1:]:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``key``, and where in it each value starts."""
    order = np.argsort(key)
    ordered = key[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the distinct pairs in their order, the place of one of each, and how often each occurs."""
    n = len(a)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    low, at = int(b.max()).bit_length(), max(1, (n - 1).bit_length())
    if int(a.max()).bit_length() + low + at <= 63:  # pair and place in one word sort fastest
        both = np.sort(a << (low + at) | b << at | np.arange(n))
        place, pair = both & ((1 << at) - 1), both >> at
        new = pair[1:] != pair[:-1]
    else:
        place = np.lexsort((b, a))
        new = (a[place][1:] != a[place][:-1]) | (b[place][1:] != b[place][:-1])
    start = np.flatnonzero(np.concatenate([[True], new]))
    sizes = np.diff(np.append(start, n))
    ids = np.empty(n, np.int64)
    ids[place] = np.repeat(np.arange(len(start)), sizes)
    return ids, place[start], sizes


def _grams(chunk: Chunk, k: int, begun: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """The places of the chunk that have a k-gram and the numbers of its words; ``begun``: only those that start with the begin."""
    at = np.arange(chunk.carried, len(chunk.ids))
    at = at[chunk.depth[at] == k - 2 if begun else chunk.depth[at] >= k - 2]
    words = [chunk.ids[at - j] for j in range(k - 1, -1, -1)]
    if k > 1:
        words[0] = np.where(chunk.depth[at] == k - 2, len(chunk.hashes) - 1, words[0])
    return at, words


def _numbered(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_pairs`` of (all words but the last, the last): distinct n-grams by their first words."""
    prefix = words[0]
    for w in words[1:-1]:
        prefix = _pairs(prefix, w)[0]
    return _pairs(prefix if len(words) > 1 else np.zeros(len(prefix), np.int64), words[-1])


# --- sorted arrays in the shared folder ---------------------------------------------

def _mounted(path: str) -> str:
    """The path under which workers open files of the shared folder."""
    if re.match(r"[a-z0-9]+:", path) and not path.startswith("file:"):
        raise ValueError(f"the shared folder must be mounted on all workers to be memory-mapped: {path}")
    return re.sub(r"^file:/+", "/", path)


def _save(folder: str, shard: int, **arrays: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, values in arrays.items():
        other = f"{folder}/.{uuid.uuid4().hex}"
        with open(other, "wb") as f:
            np.save(f, values)
        os.replace(other, f"{folder}/{name}-{shard}.npy")


@lru_cache(maxsize=256)
def _mapped(path: str) -> np.ndarray | None:
    return np.load(path, mmap_mode="r") if os.path.exists(path) else None


@dataclass(frozen=True)
class Table:
    """Hashes with ``width`` numbers each, sorted in shards; a shard that holds nothing has no file."""

    folder: str
    shards: int
    width: int = 1

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)

    def save(self, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
        small = not len(values) or values.max() < 2**32
        _save(self.folder, shard, keys=keys, values=values.astype("<u4" if small else "<u8"))

    def find(self, keys: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """The numbers of each of the distinct ``keys``; zero where it is not there."""
        place = self.place(keys) if place is None else place
        out = np.zeros((len(keys), self.width), np.int64)
        order = np.lexsort((keys, place))
        for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
            shard = place[rows[0]]
            held = _mapped(f"{self.folder}/keys-{shard}.npy")
            if held is None:
                continue
            at = np.searchsorted(held, keys[rows])
            there = at < len(held)
            there[there] = held[at[there]] == keys[rows[there]]
            out[rows[there]] = _mapped(f"{self.folder}/values-{shard}.npy")[at[there]].reshape(-1, self.width)
        return out


@dataclass(frozen=True)
class Model:
    """Tables and sums of a fitted model; ``levels[k - 1]`` has the discounts of order k."""

    folder: str
    order: int
    shards: int
    word_shards: int
    hot: int
    n_tokens: int
    n_words: int
    levels: tuple = ()
    total: tuple = (0, 0, 0, 0)  # of the empty context: T, N1, N2, N3

    @property
    def words(self) -> Table:
        return Table(f"{self.folder}/words", self.word_shards)

    def grams(self, k: int) -> Table:
        return Table(f"{self.folder}/grams-{k}", self.shards if k > 1 else self.word_shards)

    def contexts(self, k: int) -> Table:
        return Table(f"{self.folder}/contexts-{k}", self.shards if k > 2 else self.word_shards, 4)

    def place(self, words: list[np.ndarray], key: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """The shard of n-grams: that of the first word, or of the whole where the word is hot. ``counts`` of the first words, if known."""
        table = self.grams(len(words))
        if len(words) == 1:
            return table.place(key)
        first = words[0]
        if counts is None:
            names, which = np.unique(first, return_inverse=True)
            counts = self.words.find(names)[which, 0]
        return np.where((counts >= self.hot) | (first == np.uint64(BEGIN_HASH)), table.place(key), table.place(_mixed(first)))

    def save(self) -> None:
        with open(f"{self.folder}/model.json", "w") as f:
            json.dump(asdict(self), f)

    @staticmethod
    def load(folder: str) -> Model:
        with open(f"{folder}/model.json") as f:
            held = json.load(f)
        return Model(**held | {"levels": tuple(map(tuple, held["levels"])), "total": tuple(held["total"]), "folder": folder})


# --- counting ------------------------------------------------------------------------

def _names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _rows_schema(k: int) -> str:
    """Successors of the same words share a row."""
    return ", ".join([f"{c} long" for c in ["shard", *_names(k - 1)]] + [f"w{k} array<long>", "n array<long>"])


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))


def _successors(model: Model, words: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of distinct n-grams (hashes) that stand in order of all words but the last; a hot first word has a row in each shard."""
    key = key_of(words)
    shard = model.place(words, key)
    order = np.lexsort((shard, key_of(words[:-1]))) if len(words) > 1 else np.argsort(shard, kind="stable")
    words, n, shard = [w[order] for w in words], n[order], shard[order]
    new = np.ones(len(n), bool)
    new[1:] = shard[1:] != shard[:-1]
    for w in words[:-1]:
        new[1:] |= w[1:] != w[:-1]
    start = np.append(np.flatnonzero(new), len(n))
    for i in range(0, len(start) - 1, BATCH):
        at = start[i : i + BATCH + 1]
        part = slice(at[0], at[-1])
        fixed = [pa.array(c[at[:-1]].view(np.int64)) for c in (shard, *words[:-1])]
        yield pa.RecordBatch.from_arrays([*fixed, _lists(words[-1][part], at - at[0]), _lists(n[part], at - at[0])], ["shard", *_names(len(words)), "n"])


def _gram_rows(docs: DataFrame, text: str, model: Model, k: int, begun: bool = False) -> DataFrame:
    """(shard, w1..wk-1, wk array, n array): the k-grams of all texts; ``begun``: those that start with the begin."""
    def send(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        _, words = _grams(chunk, k, begun)
        if len(words[0]):
            _, first, n = _numbered(words)
            yield from _successors(model, [chunk.hashes[w[first]] for w in words], n)

    def count_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(COMBINED, k)
        for batch in batches:
            for value in batch.column(0):
                for chunk in chunks.add(0, value.as_py()):
                    yield from send(chunk)
        if chunks.parts:
            yield from send(chunks.close())

    return docs.select(text).mapInArrow(count_, _rows_schema(k))


def _dealt(rows: DataFrame, model: Model, k: int, keyed: Table | None = None) -> DataFrame:
    """``rows`` (w1..wk, ...) with their shard; by the hash of all words alone in a table ``keyed``."""
    schema = StructType([StructField("shard", LongType()), *rows.schema.fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(i).to_numpy().view(np.uint64) for i in range(k)]
            key = key_of(words)
            shard = keyed.place(key) if keyed else model.place(words, key)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], schema.names)

    return rows.mapInArrow(deal, schema)


CONTEXT, LOWER, SUMS = 0, 1, 2


def _merged(rows: DataFrame, model: Model, table: Table, k: int) -> DataFrame:
    """Stores the counts of ``rows`` (shard, w1..wk, n) in ``table`` when it is run; gives (kind, w1..wk-1, a, b, c, d).

    CONTEXT: T, N1, N2, N3 of the words' successors; LOWER: different words before the n-gram
    without its first; SUMS: the counts that are 1, 2, 3 and 4.
    """
    names = ["kind", *_names(k - 1), "a", "b", "c", "d"]

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        last, n = (group.column(c).combine_chunks() for c in (f"w{k}", "n"))
        sizes = np.diff(last.offsets.to_numpy())
        words = [np.repeat(group.column(c).to_numpy().view(np.uint64), sizes) for c in _names(k - 1)]
        words.append(last.flatten().to_numpy().view(np.uint64))
        hashes, n = key_of(words), n.flatten().to_numpy()
        order, start = _groups(hashes)
        first, n = order[start], np.add.reduceat(n[order], start)
        table.save(key[0].as_py(), hashes[first], n)
        words = [w[first] for w in words]
        classes = [np.where(n == 1, 1, 0), np.where(n == 2, 1, 0), np.where(n >= 3, 1, 0)]
        out = [[np.array([v]) for v in (SUMS, *[0] * (k - 1), *[int((n == i).sum()) for i in (1, 2, 3, 4)])]]
        if k == 1:
            out.append([np.array([v]) for v in (CONTEXT, int(n.sum()), *[int(c.sum()) for c in classes])])
        else:
            order, start = _groups(key_of(words[:-1]))
            sums = [np.add.reduceat(v[order], start) for v in (n, *classes)]
            out.append([np.full(len(start), CONTEXT), *[w[order[start]].view(np.int64) for w in words[:-1]], *sums])
            order, start = _groups(key_of(words[1:]))
            none = np.zeros(len(start), np.int64)
            out.append([np.full(len(start), LOWER), *[w[order[start]].view(np.int64) for w in words[1:]], np.diff(np.append(start, len(order))), none, none, none])
        return pa.table({c: pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i, c in enumerate(names)})

    return rows.groupBy("shard").applyInArrow(merge, ", ".join(f"{c} long" for c in names))


def _stored(rows: DataFrame, table: Table, k: int) -> DataFrame:
    """Stores context sums (shard, w1..wk, a, b, c, d) when it is run; gives the entries of each shard."""
    def store(key: tuple, group: pa.Table) -> pa.Table:
        hashes = key_of([group.column(c).to_numpy().view(np.uint64) for c in _names(k)])
        order, start = _groups(hashes)
        values = np.stack([np.add.reduceat(group.column(c).to_numpy()[order], start) for c in "abcd"], 1)
        table.save(key[0].as_py(), hashes[order[start]], values)
        return pa.table({"entries": [len(start)]})

    return rows.groupBy("shard").applyInArrow(store, "entries long")


def discounts(sums: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """D1, D2, D3 from the numbers of counts 1 to 4; usual values where these do not give sound ones."""
    n1, n2, n3, n4 = sums
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 < x <= i for i, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def fit(docs: DataFrame, text: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> Model:
    """A model of all texts of ``docs``, its tables in the shared folder."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, ceil(size / shard_bytes))
    folder = _mounted(scratch(spark, "model"))
    os.makedirs(folder, exist_ok=True)
    model = Model(folder, order, shards, max(1, ceil(shards / WORD_SHARDS)), hot, 0, 0)
    files = {}

    def run(found: DataFrame, table: Table, name: str) -> DataFrame:
        found = written(found, name)
        files[table.folder] = found
        return found

    def sums(found: DataFrame, kind: int) -> tuple:
        return tuple(v or 0 for v in found.where(F.col("kind") == kind).agg(*[F.sum(c) for c in "abcd"]).first())

    counted = run(_merged(_gram_rows(docs, text, model, 1), model, model.words, 1), model.words, "word-sums")
    n_tokens, *_ = sums(counted, CONTEXT)
    rows, levels, total = _gram_rows(docs, text, model, order), [], (0, 0, 0, 0)
    for k in range(order, 0, -1):
        merged = run(_merged(rows, model, model.grams(k), k), model.grams(k), "gram-sums")
        levels.append(discounts(sums(merged, SUMS)))
        if k == 1:
            total = sums(merged, CONTEXT)
            break
        contexts = merged.where(F.col("kind") == CONTEXT).select(*_names(k - 1), *"abcd")
        run(_stored(_dealt(contexts, model, k - 1, model.contexts(k)), model.contexts(k), k - 1), model.contexts(k), "contexts")
        lower = merged.where(F.col("kind") == LOWER).select(*_names(k - 1), F.col("a").alias("n"))
        rows = _dealt(lower, model, k - 1).withColumns({f"w{k - 1}": F.array(f"w{k - 1}"), "n": F.array("n")})
        if k > 2:
            rows = rows.unionByName(_gram_rows(docs, text, model, k - 1, begun=True))
    n_words = total[1] + total[2] + total[3]
    for table, found in files.items():  # one file for each shard that a task has reported
        there = len([f for f in os.listdir(table) if f.startswith("keys-")]) if os.path.isdir(table) else 0
        if there != (found.where(F.col("kind") == SUMS) if "kind" in found.columns else found).count():
            raise RuntimeError(f"files of the model are missing in {table}")
    model = Model(folder, order, model.shards, model.word_shards, hot, n_tokens, n_words, tuple(reversed(levels)), total)
    model.save()
    return model


# --- scoring -------------------------------------------------------------------------

def _shares(model: Model, k: int, counts: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of order k from those of the order below."""
    d = np.array([0.0, *model.levels[k - 1]])
    total = np.maximum(context[:, 0], 1)
    own = np.maximum(counts - d[np.minimum(counts, 3)], 0) / total
    rest = (context[:, 1:] @ d[1:]) / total
    return np.where(context[:, 0] > 0, own + rest * lower, lower)


def probabilities(model: Model, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(count, probability) of the chunk's own tokens."""
    at = np.arange(chunk.carried, len(chunk.ids))
    counts = model.words.find(chunk.hashes)[:, 0]
    own = counts[chunk.ids[at]]
    if not model.n_tokens:
        return own, np.ones(len(own))
    empty = np.broadcast_to(np.array(model.total), (len(at), 4))
    p = _shares(model, 1, model.grams(1).find(chunk.hashes)[:, 0][chunk.ids[at]], empty, np.full(len(at), 1 / (model.n_words + 1)))
    for k in range(2, model.order + 1):
        at, words = _grams(chunk, k)
        which, first, _ = _numbered(words)
        grams = [chunk.hashes[w[first]] for w in words]
        key = key_of(grams)
        found = model.grams(k).find(key, model.place(grams, key, counts[words[0][first]]))[which, 0]
        context, first, _ = _numbered(words[:-1])
        held = model.contexts(k).find(key_of([chunk.hashes[w[first]] for w in words[:-1]]))[context]
        p[at - chunk.carried] = _shares(model, k, found, held, p[at - chunk.carried])
    return own, p


SCORES = [("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()), ("score", DoubleType()), ("perplexity", DoubleType())]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without their text, each with its tokens, how many the model knows, the add-one unigram and the model's log10 probability."""
    names = [n for n, _ in SCORES]
    kept = [f for f in docs.schema.fields if f.name not in (text, *names)]
    schema = StructType([*kept, *[StructField(n, t) for n, t in SCORES]])

    def add(chunk: Chunk, sums: np.ndarray) -> None:
        counts, p = probabilities(model, chunk)
        row = chunk.row[chunk.carried :]
        base = np.log10((counts + 1) / (model.n_tokens + model.n_words + 1))
        for total, value in zip(sums, (None, counts > 0, base, np.log10(p))):
            total += np.bincount(row, value, minlength=len(total))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, chunks = np.zeros((4, batch.num_rows)), Chunks(STEP, model.order)
            for r, value in enumerate(batch.column(0)):
                for chunk in chunks.add(r, value.as_py()):
                    add(chunk, sums)
            if chunks.parts:
                add(chunks.close(), sums)
            n, known, base, total = sums
            whole = [pa.array(v.astype(np.int64)) for v in (n, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *whole, *[pa.array(v) for v in (base, total, 10 ** (-total / np.maximum(n, 1)))]], schema.names)

    return docs.select(text, *[f.name for f in kept]).mapInArrow(measure, schema)
