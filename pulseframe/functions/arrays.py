"""Statistics of one array column, element by element inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions.binding import let


def total(x: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def mean(x: Column) -> Column:
    return let(x, lambda v: total(v) / F.size(v))


def against(x: Column, value: Callable[[Column], Column], f: Callable[[Column, Column], Column]) -> Column:
    """``f(element, value(x))`` for each element, with ``value(x)`` evaluated once per row.

    A value captured by a lambda would be evaluated once per element.
    """
    return let(x, lambda v: F.zip_with(v, F.array_repeat(value(v), F.size(v)), f))


def centred(x: Column) -> Column:
    return against(x, mean, lambda v, mu: v - mu)


def moment(d: Column, k: int) -> Column:
    """k-th moment of an already centred array."""

    def power(v: Column) -> Column:
        out = v
        for _ in range(k - 1):
            out = out * v
        return out

    return let(d, lambda v: total(v, power) / F.size(v))


def moments(x: Column) -> Column:
    """Struct of the mean and the central moments m2, m3, m4."""
    return let(
        x,
        lambda v: let(
            centred(v),
            lambda d: F.struct(mean(v).alias("mean"), *[moment(d, k).alias(f"m{k}") for k in (2, 3, 4)]),
        ),
    )


def peak_to_peak(x: Column) -> Column:
    return let(x, lambda v: F.array_max(v) - F.array_min(v))


def successive(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """``[f(x[0], x[1]), f(x[1], x[2]), ...]``, empty for fewer than two elements."""

    def pairs(v: Column) -> Column:
        n = F.greatest(F.size(v) - 1, F.lit(0))
        return F.zip_with(F.slice(v, F.lit(1), n), F.slice(v, F.lit(2), n), f)

    return let(x, pairs)


def zero_crossing_rate(x: Column) -> Column:
    flips = successive(F.transform(x, lambda v: v > 0), lambda a, b: a != b)
    return F.size(F.filter(flips, lambda changed: changed)) / F.size(x)


def windows(x: Column, n: int, step: int) -> Column:
    """Array of (w_idx, start, end, samples), full windows only."""
    count = F.floor((F.size(x) - n) / F.lit(step)).cast("int")
    starts = F.when(F.size(x) >= n, F.sequence(F.lit(0), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda w: F.struct(
            w.alias("w_idx"), (w * step).alias("start"), (w * step + n).alias("end"),
            F.slice(x, w * step + 1, F.lit(n)).alias("samples"),
        ),
    )


def proportional_slice(x: Column, start: Column, end: Column, length: Column) -> Column:
    """Part of a channel of another rate that lies under ``[start, end)`` of a main channel."""

    def cut(v: Column) -> Column:
        n = F.size(v)
        lo = F.least(n - 1, F.floor(start * n / length)).cast("int")
        hi = F.least(n, F.floor(end * n / length)).cast("int")
        return F.slice(v, lo + 1, F.greatest(hi - lo, F.lit(0)))

    return let(x, cut)


def lead_rank(channel: Column, preferred: list[str] = C.PRIMARY_LEADS) -> Column:
    """Sort key of the primary channel: preferred names in order, then all others alike."""
    rank = F.lit(len(preferred))
    for i in reversed(range(len(preferred))):
        rank = F.when(channel == preferred[i], i).otherwise(rank)
    return rank


def tail(x: Column, n: int) -> Column:
    return F.when(F.size(x) > n, F.slice(x, -n, n)).otherwise(x)
