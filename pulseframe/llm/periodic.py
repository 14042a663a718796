"""Periodic runs of words, found by longest common extensions over a difference cover.

A run is a maximal stretch of words with smallest period q and at least ``shortest`` words and
``times`` periods. For every period q the words i and i + q are compared on a grid of i, whose
step is so wide that each run of that period covers a grid point: some n ln n comparisons in
all, the harmonic sum. How far two places agree, forwards and backwards, is answered by
``Extensions``:

- only the suffixes that start at places of a difference cover modulo ``MODULUS`` are sorted
  (prefix doubling over them), and the common prefixes of neighbours go into a sparse table;
- for any two places some distance below the modulus moves both onto cover places, so these
  few words are compared one by one and the rest is a range minimum.

The sort is made only for a text in which two places agree that far. Of equal stretches only
the least period stays: a stretch of four and more periods q with a smaller period p has
p | q, and is then itself the maximal one of p.

Scale: a text is one row's work and is never shuffled; pairs are made in slices of ``PAIRS``,
so memory is some 150 bytes a word of the longest text, also when all its words are equal.

Defined results: words are separated by ASCII white space and compared exactly; NULL and
blank texts have no words, no runs and an empty collapsed text; repeated rows are each
answered; other columns pass through unless a result has their name; an empty table gives
no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

COVER = np.array([1, 5, 11, 24, 25, 27])  # every difference modulo 31 is one of two of these
MODULUS = 31
PAIRS = 1_000_000
ROWS = 65_536  # windows of words compared at once
FLUSH = 32_000_000  # characters of an output batch

_PLACE = np.full(MODULUS, -1)
_PLACE[COVER] = np.arange(len(COVER))
_BOTH = (_PLACE[(np.arange(MODULUS)[:, None] + np.arange(MODULUS)) % MODULUS] >= 0)  # [residue, distance] on the cover
_DISTANCE = (_BOTH[:, None, :] & _BOTH[None, :, :]).argmax(axis=2)  # least distance that moves both residues onto it


class Extensions:
    """Longest common prefixes of suffixes of a sequence of non-negative numbers."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.x = np.concatenate([x, np.full(MODULUS, -1)]).astype(np.int32)
        self.rank: np.ndarray | None = None

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from places i and j on; every i is below its j, j at most n."""
        distance = _DISTANCE[i % MODULUS, j % MODULUS]
        length = np.zeros(len(i), np.int64)
        alive, arrived = np.arange(len(i)), []
        for d in range(MODULUS):
            there = distance[alive] == d
            arrived.append(alive[there])
            alive = alive[~there]
            if not len(alive):
                break
            alive = alive[self.x[i[alive] + d] == self.x[j[alive] + d]]
            length[alive] += 1
        far = np.concatenate(arrived)
        far = far[j[far] + distance[far] < self.n]
        if len(far):
            length[far] += self._between(i[far] + distance[far], j[far] + distance[far])
        return length

    def _between(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for two different places of the cover: the least of the neighbours' prefixes between their ranks."""
        if self.rank is None:
            self._sort()
        a, b = (self.rank[k // MODULUS * len(COVER) + _PLACE[k % MODULUS]] for k in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out

    def _sort(self) -> None:
        places = np.flatnonzero(_PLACE[np.arange(self.n) % MODULUS] >= 0)
        m, width = len(places), len(COVER)
        first = np.lib.stride_tricks.sliding_window_view(self.x, MODULUS)[places]
        keys = np.ascontiguousarray(first.astype(">i4")).view(f"S{4 * MODULUS}").ravel()
        rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
        levels = [rank.astype(np.int32)]
        while rank.max() + 1 < m:  # a place that lies MODULUS << k words on is ``width`` << k samples on
            step = width << (len(levels) - 1)
            after = np.zeros(m, np.int64)
            after[: max(0, m - step)] = rank[step:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank.astype(np.int32))
        self.rank = rank
        order = np.argsort(rank)
        self.least = [self._neighbours(places, order, levels).astype(np.int32)]
        while 2 ** len(self.least) < m:
            last, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of suffixes next to each other: equal ranks of halving widths, then single words."""
        a, b = order[:-1].copy(), order[1:].copy()
        m, length = len(places), np.zeros(len(order) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            at = np.flatnonzero((a < m) & (b < m))
            at = at[levels[k][a[at]] == levels[k][b[at]]]
            length[at] += MODULUS << k
            a[at] += len(COVER) << k
            b[at] += len(COVER) << k
        windows = np.lib.stride_tricks.sliding_window_view(self.x, MODULUS)
        i, j = places[order[:-1]] + length, places[order[1:]] + length
        for at in range(0, len(i), ROWS):
            part = slice(at, at + ROWS)
            inside = np.minimum(np.maximum(i[part], j[part]), self.n)  # at the end nothing agrees
            other = np.minimum(i[part], j[part])
            same = windows[inside] == windows[other]
            length[part] += np.where(same.all(axis=1), MODULUS, same.argmin(axis=1))
        return length


def word_runs(x: np.ndarray, shortest: int = 6, times: int = 4) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``x``, by start and period."""
    n = len(x)
    period = np.arange(1, n // times + 1)
    need = np.maximum(shortest, times * period)
    period, need = period[need <= n], need[need <= n]
    found = np.zeros((0, 3), np.int64)
    if not len(period):
        return found
    forward, backward = Extensions(x), Extensions(x[::-1])
    step = need - period
    points = (n - period - 1) // step + 1
    upto = np.cumsum(points)
    at = 0
    while at < len(period):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - points[at] + PAIRS, "right")))
        part = slice(at, end)
        q = np.repeat(period[part], points[part])
        i = (np.arange(len(q)) - np.repeat(upto[part] - points[part] - (upto[at] - points[at]), points[part])) * np.repeat(step[part], points[part])
        at = end
        near = np.flatnonzero(forward.x[i] == forward.x[i + q])
        if not len(near):
            continue
        i, q = i[near], q[near]
        before = backward.common(n - i - q, n - i)
        length = before + forward.common(i, i + q) + q
        enough = length >= np.maximum(shortest, times * q)
        rows = np.stack([i - before, length, q], 1)[enough]
        found = np.concatenate([found, rows])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        first = np.ones(len(found), bool)
        first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)  # of one stretch the least period
        found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


RUN = StructType([StructField(k, LongType()) for k in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, text: str = "text", shortest: int = 6, times: int = 4) -> DataFrame:
    """``docs`` without their text, each with ``n_words``, its ``runs`` and the ``collapsed`` text (one blank between words)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_words", "runs", "collapsed")]
    schema = StructType([*kept, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    arrow_run = pa.struct([(k, pa.int64()) for k in RUN.names])

    def packed(batch: pa.RecordBatch, rows: tuple[int, int], sizes: list, runs: list, texts: list) -> pa.RecordBatch:
        flat = np.concatenate(runs)
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(arrow_run))
        columns = [c.slice(rows[0], rows[1] - rows[0]) for c in batch.columns[1:]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, structs), pa.array(texts, pa.string())], schema.names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, sizes, runs, texts, held = 0, [], [], [], 0
            for r, value in enumerate(batch.column(0)):
                words = (value.as_py() or "").encode().split()
                number = defaultdict(count().__next__)
                x = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
                found = word_runs(x, shortest, times)
                if len(found):
                    words = compress(words, kept_words(len(x), found))
                sizes.append(len(x))
                runs.append(found)
                texts.append(b" ".join(words).decode())
                held += len(texts[-1])
                if held >= FLUSH:
                    yield packed(batch, (begun, r + 1), sizes, runs, texts)
                    begun, sizes, runs, texts, held = r + 1, [], [], [], 0
            if sizes:
                yield packed(batch, (begun, batch.num_rows), sizes, runs, texts)

    return docs.select(text, *[f.name for f in kept]).mapInArrow(find, schema)
