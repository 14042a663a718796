"""Variability of the beats held in one (bounded) array per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import arrays as A
from pulseframe.functions.binding import let


def variability(
    times: Column, interval: Callable[[Column, Column], Column], valid: tuple[float, float] = C.RR_VALID_MS,
    nn_step: float = C.NN_STEP_MS, per_minute: float = 60000.0,
) -> Column:
    """Struct of the eight time-domain features of an ordered array of beat times.

    ``interval`` turns two successive times into the unit of ``valid`` (milliseconds by
    default). Implausible intervals are left out unless fewer than two would remain.
    """

    def usable(rr: Column) -> Column:
        kept = F.filter(rr, lambda x: (x >= valid[0]) & (x <= valid[1]))
        return let(kept, lambda k: F.when(F.size(k) >= 2, k).otherwise(rr))

    def describe(use: Column, step: Column, hr: Column) -> list[Column]:
        n, m = F.size(use), F.size(step)
        sd = F.when(n > 1, F.sqrt(A.total(A.centred(use), lambda d: d * d) / (n - 1))).otherwise(0.0)
        rmssd = F.when(m > 0, F.sqrt(A.total(step, lambda d: d * d) / m)).otherwise(0.0)
        pnn = F.when(m > 0, F.size(F.filter(step, lambda d: F.abs(d) > nn_step)) / m * 100.0).otherwise(0.0)
        return [A.mean(use), sd, rmssd, pnn, A.mean(hr), F.array_min(hr), F.array_max(hr), A.peak_to_peak(hr)]

    def features(use: Column) -> Column:
        parts = F.struct(A.successive(use, lambda a, b: b - a).alias("step"), F.transform(use, lambda x: F.lit(per_minute) / x).alias("hr"))
        return let(
            parts,
            lambda s: F.struct(*[v.alias(c) for c, v in zip(C.FEATURES_TIME, describe(use, s["step"], s["hr"]))]),
        )

    none = F.struct(*[F.lit(d).alias(c) for c, d in zip(C.FEATURES_TIME, C.TIME_DEFAULTS)])
    return let(
        times,
        lambda t: F.when(F.size(t) < 3, none).otherwise(let(A.successive(t, interval), lambda rr: let(usable(rr), features))),
    )


def hrv_from_times(df: DataFrame, times: str, interval: Callable[[Column, Column], Column], **limits) -> DataFrame:
    """Add the eight time-domain columns."""
    return df.withColumn("_hrv", variability(F.col(times), interval, **limits)).select(*df.columns, "_hrv.*")
