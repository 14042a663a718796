"""Wear sessions and request quotas over event logs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.series import previous, running_sum, scan, time_chunk


def wear_sessions(df: DataFrame, key: list[str], ts: str, gap_seconds: int, grain_seconds: int = 60) -> DataFrame:
    """Runs of events without a pause of ``gap_seconds``: start, end, n.

    Events are first merged per (key, minute) with map-side combine; a minute never spans a
    session break, and a key has at most one row per minute left for the ordered step.
    """
    grain = min(grain_seconds, gap_seconds)
    slots = df.groupBy(*key, time_chunk(ts, grain).alias("_slot")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*key).orderBy("_slot")
    pause = F.unix_micros("_first") - F.unix_micros(F.lag("_last").over(order))
    marked = slots.withColumn("_new", F.when(pause < gap_seconds * 1_000_000, 0).otherwise(1))
    numbered = marked.withColumn("_session", F.sum("_new").over(order))
    return numbered.groupBy(*key, "_session").agg(
        F.min("_first").alias("session_start"), F.max("_last").alias("session_end"), F.sum("_n").alias("n")).drop("_session")


def requested_rate(df: DataFrame, client: str, ts: str, horizon_seconds: float, limit: int) -> DataFrame:
    """Requests of the client in the trailing horizon (this one included) and whether they exceed the limit.

    A row is copied to its own time slot and the next; counting inside (client, slot) sees the
    whole horizon, and a busy client is spread over its slots. A request without a time is
    counted for nobody and has NULL for both.
    """
    h = int(horizon_seconds * 1_000_000)
    at = F.unix_micros(ts)
    slot = F.floor(at / F.lit(h))
    copies = df.withColumn("_at", at).withColumn("_own", slot).withColumn("_slot", F.explode(F.when(slot.isNull(), F.array(slot)).otherwise(F.array(slot, slot + 1))))
    w = Window.partitionBy(client, "_slot").orderBy("_at").rangeBetween(-(h - 1), 0)
    counted = copies.withColumn("requested", F.when(F.col("_at").isNotNull(), F.count(F.lit(1)).over(w))).where(F.col("_own").eqNullSafe(F.col("_slot")))
    return counted.withColumn("over_limit", F.col("requested") > limit).drop("_at", "_own", "_slot")


def admit(history: deque, now: int, horizon: int, limit: int) -> tuple[bool, int]:
    """One quota decision; ``history`` holds the admitted times still inside the horizon."""
    while history and history[0] <= now - horizon:
        history.popleft()
    if len(history) >= limit:
        return False, 0
    history.append(now)
    return True, limit - len(history)


def admitted(df: DataFrame, client: str, order: list[str], horizon_seconds: float, limit: int) -> DataFrame:
    """Quota where only admitted requests count: (allowed, remaining) per request, ``order[0]`` being the time.

    A decision depends on earlier decisions, so it is made in sequence; a pause of a whole
    horizon empties the history, which makes the runs between pauses independent. Runs are
    spread over the cluster and streamed in order with at most ``limit`` times in memory.
    A request without a time is not decided: both results are NULL.
    """
    h = int(horizon_seconds * 1_000_000)
    ts = order[0]
    at = F.struct(*order)
    keep = df.columns
    timed = df.where(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(ts))
    first = scan(timed, [client], order, time_chunk(ts), {"_prev": previous(F.col("_at"), at)})
    fresh = F.when(F.col("_at") - F.col("_prev") < h, 0).otherwise(1)
    runs = scan(first.withColumn("_new", fresh), [client], order, time_chunk(ts), {"_run": running_sum(F.col("_new"))})
    ready = runs.repartition(client, "_run").sortWithinPartitions(client, "_run", *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, history = None, deque()
        for b in batches:
            allowed, left = [], []
            for who, run, now in zip(b[client].astype(object).where(b[client].notna(), None), b["_run"], b["_at"]):
                if (who, run) != current:
                    current, history = (who, run), deque()
                ok, remaining = admit(history, now, h, limit)
                allowed.append(ok)
                left.append(remaining)
            yield b[keep].assign(allowed=allowed, remaining=left)

    decided = ready.mapInPandas(decide, f"{fields}, allowed boolean, remaining long")
    untimed = df.where(F.col(ts).isNull()).select("*", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("remaining"))
    return decided.union(untimed)


def latest_state(df: DataFrame, key: str, order: list[str | Column], fields: list[str]) -> DataFrame:
    """Newest values per device, whatever the arrival order (map-side combined)."""
    newest = F.max_by(F.struct(*fields), F.struct(*order))
    return df.groupBy(key).agg(newest.alias("_s")).select(key, "_s.*")


def newest_per_key(df: DataFrame, key: str, order: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` newest rows per key. Spark keeps only k rows per key and task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
