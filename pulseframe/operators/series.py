"""Ordered computations over series whose rows may be concentrated in one key.

A plain ``Window.partitionBy(key)`` sends a whole device to one task. Here every key is cut
into chunks of its ordering column (a minute of time, a slice of values). Work that follows
the order runs inside ``(key, chunk)``; one summary row per chunk, built with map-side
combine, carries what a chunk needs to know about the chunks before or after it. The rows
are shuffled once, on ``(key, chunk)``; a device holding a third of all rows is spread over
as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHUNK = "_chunk"
BLOCK = "_block"
GRAIN_SECONDS = 60


def time_chunk(ts: str | Column, seconds: int = GRAIN_SECONDS) -> Column:
    """Chunk number of an instant. One device at 2000 Hz puts 120 000 rows in a minute."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def value_chunk(value: str | Column, width: float = 1.0) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(width))


@dataclass(frozen=True)
class Part:
    """One ordered computation, split into its within-chunk and across-chunk halves."""

    summary: Column  # aggregate over the rows of a chunk
    across: Callable[[Column, WindowSpec], Column]  # over chunk summaries of a key, in order
    within: Callable[[WindowSpec], Column] | None = None  # over the rows of a chunk, in order
    merge: Callable[[Column | None, Column], Column] = lambda inner, outer: F.coalesce(inner, outer)
    backward: bool = False  # both windows run from the end


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def position() -> Part:
    """0-based position of the row in its key."""
    return Part(
        summary=F.count(F.lit(1)),
        across=lambda s, w: F.coalesce(F.sum(s).over(_before(w)), F.lit(0)),
        within=lambda w: F.row_number().over(w),
        merge=lambda inner, outer: (inner + outer - 1).cast("long"),
    )


def running_sum(expr: Column) -> Part:
    """Inclusive running total of ``expr``."""
    return Part(
        summary=F.sum(expr),
        across=lambda s, w: F.coalesce(F.sum(s).over(_before(w)), F.lit(0)),
        within=lambda w: F.sum(expr).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        merge=lambda inner, outer: inner + outer,
    )


def key_total(agg: Column) -> Part:
    """A sum-like aggregate of the whole key on each of its rows."""
    return Part(
        summary=agg,
        across=lambda s, w: F.sum(s).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        merge=lambda _inner, outer: outer,
    )


def last_valid(expr: Column, order: Column, inclusive: bool = True) -> Part:
    """Latest non-null ``expr`` up to (or strictly before) the row."""
    return Part(
        summary=F.max_by(expr, F.when(expr.isNotNull(), order)),
        across=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        within=lambda w: F.last(expr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)),
    )


def next_valid(expr: Column, order: Column, inclusive: bool = True) -> Part:
    """Earliest non-null ``expr`` from (or strictly after) the row on.

    A frame that reaches to the end is computed anew for every row, a time that grows with the
    square of the group; from the end it is a running value.
    """
    return Part(
        summary=F.min_by(expr, F.when(expr.isNotNull(), order)),
        across=lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        within=lambda w: F.last(expr, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)),
        backward=True,
    )


def previous(expr: Column, order: Column) -> Part:
    """``lag(expr)``; ``expr`` must not be null."""
    return Part(
        summary=F.max_by(expr, order),
        across=lambda s, w: F.lag(s).over(w),
        within=lambda w: F.lag(expr).over(w),
    )


def solid(df: DataFrame, columns: list[str], prefix: str = "_g") -> tuple[DataFrame, list[str]]:
    """``df`` with never-NULL stand-ins for ``columns``, and their names.

    An equi-join or a shuffle on the stand-ins keeps rows with NULL keys, which a join on the
    columns would lose; unlike ``<=>`` it leaves the join keys plain columns, so a partitioning
    on them is used again. A bit mask tells a NULL from the default that stands for it.
    """
    mask = F.lit(0)
    added = {}
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        zero = F.lit("1970-01-01") if kind.typeName() in ("date", "timestamp", "timestamp_ntz") else F.lit("") if kind.typeName() in ("string", "binary") else F.lit(0)
        added[f"{prefix}{i}"] = F.coalesce(F.col(c), zero.cast(kind))
        mask = mask + F.when(F.col(c).isNull(), 1 << i).otherwise(0)
    return df.withColumns({**added, f"{prefix}n": mask}), [*added, f"{prefix}n"]


def scan(df: DataFrame, key: list[str], order: list[str], chunk: Column, parts: dict[str, Part]) -> DataFrame:
    """Add one column per part. ``chunk`` must grow with ``order`` inside a key.

    Every row stays: NULL keys are one key, and rows with a NULL order come first in theirs.
    """
    rows, own = solid(df.withColumn(CHUNK, chunk), [*key, CHUNK])
    sums = rows.groupBy(*own).agg(F.first(CHUNK).alias(CHUNK), *[F.first(c).alias(f"_k_{c}") for c in key], *[p.summary.alias(f"_s_{n}") for n, p in parts.items()])
    of_key = Window.partitionBy(*[f"_k_{c}" for c in key])
    across = {False: of_key.orderBy(CHUNK), True: of_key.orderBy(F.desc(CHUNK))}
    sums = sums.select(*own, *[p.across(F.col(f"_s_{n}"), across[p.backward]).alias(f"_a_{n}") for n, p in parts.items()])
    of_chunk = Window.partitionBy(*own)
    within = {False: of_chunk.orderBy(*order), True: of_chunk.orderBy(F.desc("_at"))}
    local = rows
    if any(p.backward for p in parts.values()):  # rows that ``order`` leaves open turn round too
        local = rows.withColumn("_at", F.row_number().over(within[False]))
    local = local.select("*", *[p.within(within[p.backward]).alias(f"_w_{n}") for n, p in parts.items() if p.within])
    joined = local.join(sums, own)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            p.merge(F.col(f"_w_{n}") if p.within else None, F.col(f"_a_{n}")).alias(n)
            for n, p in parts.items()
        ],
    )


def indexed(df: DataFrame, key: list[str], order: list[str], chunk: Column, pos: str = "idx", total: str | None = None) -> DataFrame:
    """0-based position per key and, on request, the key's row count."""
    parts = {pos: position()}
    if total:
        parts[total] = key_total(F.count(F.lit(1)))
    return scan(df, key, order, chunk, parts)


def neighbourhood(
    df: DataFrame,
    key: list[str],
    pos: str,
    halo: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    block: int = 1 << 16,
) -> DataFrame:
    """Window expressions that look at most ``halo`` rows back or ahead.

    A key is cut into blocks of ``block`` positions; rows near an edge are also copied to the
    neighbouring block so that each block sees its surroundings. Groups hold at most
    ``block + 2 * halo`` rows.
    """
    copies = _with_halo(df, pos, halo, block)
    w = Window.partitionBy(*key, BLOCK).orderBy(pos)
    out = copies.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return out.where(F.col("_own") == F.col(BLOCK)).drop("_own", BLOCK)


def _with_halo(df: DataFrame, pos: str, halo: int, block: int) -> DataFrame:
    """Rows with their own block, and a copy in the neighbouring block of each that is within ``halo`` of it."""
    own = F.floor(F.col(pos) / block)
    offset = F.col(pos) % block
    first = own - F.when((offset < halo) & (own > 0), 1).otherwise(0)
    last = own + F.when(offset >= block - halo, 1).otherwise(0)
    return df.select("*", own.alias("_own"), F.explode(F.sequence(first, last)).alias(BLOCK))


def slabs(
    df: DataFrame,
    key: list[str],
    pos: str,
    value: str,
    halo: int,
    outputs: list[StructField],
    kernel: Callable[[np.ndarray, int], list[pa.Array]],
    block: int = 1 << 16,
) -> DataFrame:
    """``df`` with columns that a numpy ``kernel`` makes from stretches of a series, for work no window expression has.

    Positions of a key are 0, 1, 2, ... without gaps. The kernel gets the samples of a block
    with up to ``halo`` more on both sides, missing ones (NULL or NaN) as NaN, and the
    position of the first of them; it gives one array per output, as long as what it got.
    A task holds one block.
    """
    if halo > block:
        raise ValueError(f"a halo of {halo} needs blocks of at least as many samples")
    schema = StructType([*df.schema.fields, *outputs])
    given = df.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(pos)
        x = group.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        made = kernel(np.where(np.isnan(x), np.nan, x), group.column(pos)[0].as_py())
        own = pa.array(group.column("_own").to_numpy() == group.column(BLOCK).to_numpy())
        columns = [*[group.column(c) for c in given], *made]
        return pa.table(columns, names=schema.names).filter(own)

    return _with_halo(df, pos, halo, block).groupBy(*key, BLOCK).applyInArrow(run, schema)
