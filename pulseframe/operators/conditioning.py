"""Imputation, scaling and detrending over long series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from pulseframe.functions import dsp
from pulseframe.functions.sensors import present
from pulseframe.operators.lookup import lookup
from pulseframe.operators.quantiles import distinct_values, quantiles_of
from pulseframe.operators.series import last_valid, next_valid, scan, slabs, solid
from pulseframe.sources.sinks import materialise


def impute_linear(df: DataFrame, key: list[str], order: list[str], chunk: Column, value: str, pos: str, out: str) -> DataFrame:
    """Fill gaps (NULL or NaN) on the straight line between the valid neighbours; ends take the nearest one.

    A key without any valid sample becomes zeros.
    """
    at, known = F.col(pos), present(F.col(value))
    valid = F.when(known.isNotNull(), F.struct(at.alias("i"), known.alias("v")))
    filled = scan(df, key, order, chunk, {"_prev": last_valid(valid, at), "_next": next_valid(valid, at)})
    p, q = F.col("_prev"), F.col("_next")
    line = p["v"] + (q["v"] - p["v"]) * (at - p["i"]) / (q["i"] - p["i"])
    return filled.withColumn(
        out,
        F.when(known.isNotNull(), known)
        .when(p.isNotNull() & q.isNotNull(), line)
        .otherwise(F.coalesce(p["v"], q["v"], F.lit(0.0))),
    ).drop("_prev", "_next")


def _of_keys(df: DataFrame, key: list[str], values: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``columns`` of its key's ``stats``, spread by the key's rows, missing ones included."""
    rows, own = solid(values.groupBy(*key).agg(F.sum("_c").alias("_rows")), key)
    found = rows.join(solid(stats, key)[0].drop(*key), own, "left").drop(*own)
    return lookup(df, found, key, "_rows", columns)


def impute_median(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """Missing (NULL or NaN) becomes the key's median; zero where the key has no value."""
    values = distinct_values(df, key, value)
    filled = _of_keys(df, key, values, quantiles_of(values, key, {"_median": 0.5}), ["_median"])
    return filled.withColumn(out, F.coalesce(present(F.col(value)), F.col("_median"), F.lit(0.0))).drop("_median")


def impute_zero(value: Column) -> Column:
    return F.coalesce(present(value), F.lit(0.0))


def _spread(values: DataFrame, key: list[str], stats: DataFrame, centre: str) -> DataFrame:
    """``stats`` with the population deviation ``_std``; squares are taken around ``centre``, so none cancel."""
    rows, own = solid(values.where("_v IS NOT NULL"), key)
    held, _ = solid(stats, key)
    off = F.col("_v") - F.col(centre)
    n, first, second = F.sum("_c"), F.sum(F.col("_c") * off), F.sum(F.col("_c") * off * off)
    spread = rows.join(held.select(*own, centre), own).groupBy(*own).agg(F.sqrt(F.greatest(second / n - F.pow(first / n, 2), F.lit(0.0))).alias("_std"))
    return held.join(spread, own, "left").drop(*own)


def robust_scale(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """(x - median) / IQR, or over the standard deviation when the IQR vanishes; missing (NULL or NaN) becomes NULL."""
    values = distinct_values(df, key, value)
    q = materialise(quantiles_of(values, key, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}), "quartiles")
    iqr = F.col("_q3") - F.col("_q1")
    centred = present(F.col(value)) - F.col("_q2")
    return (
        _of_keys(df, key, values, _spread(values, key, q, "_q2"), ["_q1", "_q2", "_q3", "_std"])
        .withColumn(out, F.when(iqr < 1e-6, centred / (F.col("_std") + 1e-6)).otherwise(centred / iqr))
        .drop("_q1", "_q2", "_q3", "_std")
    )


def median_detrend(df: DataFrame, key: list[str], pos: str, value: str, kernel: int, out: str, block: int = 1 << 16) -> DataFrame:
    """x minus its running median; samples beyond the ends, and missing ones (NULL or NaN), count as zero in it."""
    if kernel % 2 == 0:
        kernel += 1

    def base(x: np.ndarray, _first: int) -> list[pa.Array]:
        return [pa.array(dsp.series_median(np.nan_to_num(x), kernel))]

    found = slabs(df, key, pos, value, kernel // 2, [StructField("_base", DoubleType())], base, block)
    return found.withColumn(out, F.col(value) - F.col("_base")).drop("_base")
