"""Joining one row per key back onto many rows per key, whatever the skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators.series import solid

HOT_ROWS = 10_000_000
SALTS = 4096


def lookup(df: DataFrame, per_key: DataFrame, key: list[str], count: str, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``columns`` of ``per_key``; rows without a partner get NULLs, NULL keys find their own row.

    ``count`` is the number of ``df`` rows of a key, missing values included. Keys above
    ``hot_rows`` go by broadcast: there are at most (rows of df / hot_rows) of them, 200 000 in
    two trillion rows. Their rows are salted in the shuffle that serves the other keys, so no
    task receives a hot key.
    """
    rows, own = solid(df, key, "_l")
    per_key, _ = solid(per_key, key, "_l")
    hot = per_key.where(F.col(count) > hot_rows).select(*own, F.struct(*columns).alias("_hot"))
    cold = per_key.where(F.col(count) <= hot_rows).select(*own, F.lit(0).cast("long").alias("_salt"), F.struct(*columns).alias("_cold"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)) + 1
    rows = rows.join(F.broadcast(hot), own, "left").withColumn("_salt", F.when(F.col("_hot").isNotNull(), spread).otherwise(0))
    both = rows.join(cold, [*own, "_salt"], "left").withColumn("_looked", F.coalesce("_hot", "_cold"))
    return both.select(*df.columns, *[F.col(f"_looked.{c}").alias(c) for c in columns])
