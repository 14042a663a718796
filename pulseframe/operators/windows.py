"""Sample windows and packets over long (one row per sample) series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.series import CHUNK, solid, time_chunk


def sliding(df: DataFrame, n: int, step: int | None = None, pos: str = "idx", total: str = "total") -> DataFrame:
    """Attach each row to the full windows that hold it: one output row per (row, w)."""
    step = step or n // 2
    first = F.greatest(F.ceil((F.col(pos) - n + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col(pos) / F.lit(step)), F.floor((F.col(total) - n) / F.lit(step)))
    return df.where((F.col(total) >= n) & (first <= last)).withColumn("w", F.explode(F.sequence(first, last)))


def tumbling(df: DataFrame, n: int, pos: str = "idx") -> DataFrame:
    return df.withColumn("packet", F.floor(F.col(pos) / n))


def blocks(df: DataFrame, key: list[str], step: int, channels: list[str], pos: str = "idx") -> DataFrame:
    """Long rows to blocks of ``step`` samples: one array per channel, at most ``step`` long."""
    sample = F.struct(pos, *channels)
    out = df.groupBy(*key, F.floor(F.col(pos) / step).alias("block_idx")).agg(F.sort_array(F.collect_list(sample)).alias("_b"))
    return out.select(*key, "block_idx", *[F.col(f"_b.{c}").alias(c) for c in channels])


def from_blocks(df: DataFrame, key: list[str], step: int, channels: list[str]) -> DataFrame:
    """Half-overlapping windows of ``2 * step`` samples: a block joins the window it opens and the one before.

    Grouping on (key, window) keeps a long record spread out; ``lead`` over the record would not.
    """
    b = F.col("block_idx")
    member = F.struct("block_idx", *channels)
    spread = df.select(*key, member.alias("_b"), F.explode(F.sequence(F.greatest(b - 1, F.lit(0)), b)).alias("w_idx"))
    pairs = spread.groupBy(*key, "w_idx").agg(F.sort_array(F.collect_list("_b")).alias("_p"))
    joined = pairs.select(*key, "w_idx", *[F.flatten(F.col(f"_p.{c}")).alias(c) for c in channels])
    return joined.where(F.size(channels[0]) == 2 * step)


def event_time_counts(df: DataFrame, ts: str, keys: list[str], length: str, slide: str) -> DataFrame:
    """Counts per event-time window; the same expression serves batch and stream."""
    return (
        df.groupBy(F.window(ts, length, slide).alias("_win"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_win.start").alias("window_start"), F.col("_win.end").alias("window_end"), *keys, "n")
    )


def align_secondary(
    df: DataFrame, key: list[str], order: list[str], ts: str, is_main: Column, value: Column, n: int, step: int
) -> DataFrame:
    """Secondary-channel statistics under each window of the main channel.

    The slice bounds grow linearly with the window number, so the windows that can hold a
    secondary row follow from its position by arithmetic; no range join is needed.
    """
    rows = df.select(*key, *order, value.alias("_v"), is_main.alias("_main"))
    chunk = time_chunk(ts)
    grouped = rows.withColumn(CHUNK, chunk)
    per_chunk = grouped.groupBy(*key, CHUNK, "_main").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*key)
    whole = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy(*key, "_main").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = per_chunk.select(
        *key, CHUNK, "_main",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum(F.when(F.col("_main"), F.col("_n")).otherwise(0)).over(whole).alias("len_main"),
        F.sum(F.when(F.col("_main"), 0).otherwise(F.col("_n"))).over(whole).alias("len_second"),
    )
    local = Window.partitionBy(*key, CHUNK, "_main").orderBy(*order)
    numbered, own = solid(grouped.withColumn("_rn", F.row_number().over(local)), [*key, CHUNK, "_main"])
    summary = solid(summary, [*key, CHUNK, "_main"])[0].drop(*key, CHUNK, "_main")
    placed = numbered.join(summary, own).drop(*own).withColumn("_pos", F.col("_rn") - 1 + F.col("_before"))
    l1, l2 = F.col("len_main"), F.col("len_second")

    def bounds(w: Column) -> tuple[Column, Column]:
        start, end = w * step, w * step + n
        lo = F.greatest(F.least(l2 - 1, F.floor(start * l2 / l1)), F.lit(0))
        return lo, F.least(l2, F.floor(end * l2 / l1))

    # every window once, from the main row that opens it
    starts = placed.where(F.col("_main") & (F.col("_pos") % step == 0) & (F.col("_pos") + n <= l1)).withColumn(
        "w", F.floor(F.col("_pos") / step)
    )
    lo, hi = bounds(F.col("w"))
    openers = starts.select(*key, "w", lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_hit"))
    # each secondary row with the few windows that may hold it
    edge = (F.col("_pos") + 1) * l1 / l2
    first = F.greatest(F.floor((edge - n) / step) - 1, F.lit(0))
    last = F.least(F.ceil(edge / step) + 1, F.floor((l1 - n) / F.lit(step)))
    members = (
        placed.where(~F.col("_main") & (l1 >= n))
        .where(first <= last)
        .withColumn("w", F.explode(F.sequence(first, last)))
    )
    members = members.select(*key, "w", lo.alias("lo"), hi.alias("hi"), "_v", F.lit(1).alias("_hit"), "_pos").where(
        (F.col("_pos") >= F.col("lo")) & (F.col("_pos") < F.col("hi"))
    ).drop("_pos")
    return openers.unionByName(members).groupBy(*key, "w").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("_hit").alias("n"), F.avg("_v").alias("avg_v")
    )
