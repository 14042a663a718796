"""Nearest neighbours by cosine with a block matrix join over int8 tiles.

Queries and candidates are dealt into blocks, and every query block meets every candidate
block in one task (a tile). In the tile both sides are unit vectors in int8 codes, each with
the norm e of its rounding error; the integer product then gives every cosine within
``e_q + (1 + e_q) * e_c``. A pair survives when its upper bound reaches the k-th best score
known for its query; only survivors are recomputed, in double precision on the original
vectors. Each tile leaves at most k rows a query; these are merged in heaps. The answer is
exact: the bounds never drop a true neighbour, ties included.

Scale: a tile holds about ``QUERY_BLOCK`` queries and ``BLOCK`` candidates whatever the table
holds, the numbers of blocks follow from counts, and products are made in small squares.
Blocks are hash shares of distinct (id, vector) rows, so a vector that fills a third of the
table is spread over all blocks, and a query it equals still leaves k rows a tile.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components take no
part, nor do rows with a NULL id; only vectors of equal length are compared; rows that repeat
id and vector count once; rows sharing the query's id are its own and no candidates; an id
with several vectors is a candidate, or a query, with each; a query with fewer than k
candidates gets them all, one with none gets no row; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
QUERY_BLOCK = 4096
SQUARE = 1024  # rows and columns of one product
SLACK = 1e-6  # far above the rounding of the products


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, dim): distinct comparable vectors as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(finite).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    values = values[order]
    # powers of two keep the squares of extreme values finite and change no quotient
    return ids[order], np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])


def _codes(values: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as floats for the product), their scale, and the norm of their error."""
    unit = values / norms[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8).astype(np.float32), scale, error


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products, exact in single precision up to 1024 columns at a time."""
    return sum((a[:, i : i + 1024] @ b[:, i : i + 1024].T).astype(np.float64) for i in range(0, a.shape[1], 1024))


def _leading(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's k best: by score, then by smaller id; sorted by owner."""
    order = np.lexsort((ids, -score, owner))
    start = np.concatenate([[True], owner[order][1:] != owner[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0)) if len(order) else start
    return order[np.arange(len(order)) - first < k]


def tile(queries: pa.Table, candidates: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score): the k best candidates of each query in this tile."""
    q_ids, q = _matrix(queries)
    c_ids, c = _matrix(candidates)
    q_norm, c_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((c * c).sum(axis=1))
    (q_code, q_scale, q_err), (c_code, c_scale, c_err) = _codes(q, q_norm), _codes(c, c_norm)
    out = []
    for i in range(0, len(q), SQUARE):
        qs = slice(i, i + SQUARE)
        n = len(q_ids[qs])
        owner, ids, score = np.zeros(0, np.int64), np.zeros(0, c_ids.dtype), np.zeros(0)
        known = np.full(n, -np.inf)
        for j in range(0, len(c), SQUARE):
            cs = slice(j, j + SQUARE)
            about = _product(q_code[qs], c_code[cs]) * q_scale[qs][:, None] * c_scale[cs][None, :]
            bound = q_err[qs][:, None] + (1 + q_err[qs][:, None]) * c_err[cs][None, :] + SLACK
            own = q_ids[qs][:, None] == c_ids[cs][None, :]
            about[own] = -np.inf
            low = about - bound
            if low.shape[1] >= k:
                known = np.maximum(known, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            r, s = np.nonzero((about + bound >= known[:, None]) & ~own)
            exact = np.empty(len(r))
            for p in range(0, len(r), 65536):
                a, b = r[p : p + 65536], s[p : p + 65536]
                exact[p : p + 65536] = (q[qs][a] * c[cs][b]).sum(axis=1) / (q_norm[qs][a] * c_norm[cs][b])
            owner, ids, score = np.concatenate([owner, r]), np.concatenate([ids, c_ids[cs][s]]), np.concatenate([score, exact])
            best = _leading(owner, ids, score, k)
            owner, ids, score = owner[best], ids[best], score[best]
            counts = np.bincount(owner, minlength=n)
            last = np.cumsum(counts) - 1
            full = counts == k
            known[full] = np.maximum(known[full], score[last[full]] - SLACK)
        out.append((q_ids[qs][owner], ids, score))
    return tuple(np.concatenate([o[x] for o in out]) for x in range(3))


def nearest(vectors: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row that ``query`` selects."""
    rows = valid(vectors, vec_id, vector)
    asked = valid(vectors.where(query), vec_id, vector)
    n, m = rows.count(), asked.count()
    parts, asks = max(1, ceil(n / BLOCK)), max(1, ceil(m / QUERY_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    right = rows.select("id", "v", "dim", block(parts).alias("c_block"), every(asks).alias("q_block"))
    left = asked.select("id", "v", "dim", block(asks).alias("q_block"), every(parts).alias("c_block"))
    names = ["query_id", "vec_id", "score"]

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return pa.table(dict(zip(names, tile(queries, candidates, k))))

    keys = ["dim", "q_block", "c_block"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for q, c, s in zip(*(batch.column(x).to_pylist() for x in names)):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -c))
                else:
                    heapq.heappushpop(heap, (s, -c))
        out = [(q, i + 1, -c, s) for q, heap in heaps.items() for i, (s, c) in enumerate(sorted(heap, reverse=True))]
        for i in range(0, len(out), 10_000):
            a, b, c, d = zip(*out[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], ["query_id", "rank", "vec_id", "score"])

    return tiles.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
