"""Exact quantiles per key without holding a key's values in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.sensors import present
from pulseframe.operators.lookup import lookup
from pulseframe.operators.series import key_total, running_sum, scan
from pulseframe.sources.sinks import materialise

SLICES = 64


def distinct_values(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, _v, _c): how often each value occurs, written once; missing (NULL or NaN) is one of them."""
    known = df.select(*key, present(F.col(value).cast("double")).alias("_v"))
    return materialise(known.groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c")), "values")


def exact_quantiles(df: DataFrame, key: list[str], value: str, probs: dict[str, float], count: str | None = None, slices: int = SLICES) -> DataFrame:
    """Linear-interpolation quantiles of the values that are not missing (NULL or NaN), one row per key.

    ``count`` adds the number of values. ``df`` is read once.
    """
    return quantiles_of(distinct_values(df, key, value), key, probs, count, slices)


def quantiles_of(values: DataFrame, key: list[str], probs: dict[str, float], count: str | None = None, slices: int = SLICES) -> DataFrame:
    """The quantiles from ``distinct_values``.

    Equal values are merged first (sensor samples are quantised, so this is most of them);
    ranks then come from a chunked running count over value slices. The slices' edges are
    approximate quantiles of the key's own distinct values (a sketch, merged map-side), so a
    slice holds about a ``slices``-th of them whatever the unit and spread of the signal.
    """
    merged = values.where("_v IS NOT NULL")
    sketch = F.percentile_approx("_v", [i / slices for i in range(1, slices)], 10 * slices)
    edges = merged.groupBy(*key).agg(sketch.alias("_edges"), F.count(F.lit(1)).alias("_distinct"))
    placed = lookup(merged, edges, key, "_distinct", ["_edges"])
    slice_ = F.size(F.filter("_edges", lambda e: e < F.col("_v")))
    ranked = scan(
        placed.select(*key, "_v", "_c", slice_.alias("_slice")), key, ["_v"], F.col("_slice"),
        {"_end": running_sum(F.col("_c")), "_n": key_total(F.sum("_c"))},
    )
    start = F.col("_end") - F.col("_c")
    holds = {}
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds[f"_{name}_{side}"] = (rank >= start) & (rank < F.col("_end"))
    hit = ranked.withColumns(holds)
    any_hit = F.lit(False)
    for h in holds:
        any_hit = any_hit | F.col(h)
    picked = hit.where(any_hit).groupBy(*key).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col(h), F.col("_v"))).alias(h) for h in holds]
    )
    out = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    if count:
        out.append(F.col("_n").alias(count))
    return picked.select(*key, *out)
