"""Per-key and per-row features computed with built-in expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from pulseframe import constants as C
from pulseframe.functions import arrays as A
from pulseframe.functions import dsp
from pulseframe.functions.binding import let
from pulseframe.functions.sensors import present
from pulseframe.operators.lookup import lookup
from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.operators.series import last_valid, neighbourhood, previous, running_sum, scan, slabs
from pulseframe.sources.sinks import materialise


def energy_envelope(df: DataFrame, key: list[str], pos: str, value: str, length: int, out: str = "env", block: int = 1 << 16) -> DataFrame:
    """Moving mean of the squared first difference (zero beyond the ends).

    The difference series is one shorter than the signal; row ``i`` carries the difference
    between samples ``i`` and ``i + 1``. Rows whose next sample is missing have no envelope.
    """
    def envelope(x: np.ndarray, _first: int) -> list[pa.Array]:
        env = np.append(dsp.slope_energy(x, length), 0.0)
        return [pa.array(env, mask=np.isnan(np.append(x[1:], np.nan)))]

    return slabs(df, key, pos, value, length + 1, [StructField(out, DoubleType())], envelope, block).where(F.col(out).isNotNull())


PLATEAU = 1024  # equal envelope values in a row whose middle is still found


def long_r_peaks(df: DataFrame, key: list[str], pos: str, value: str, fs: float, block: int = 1 << 16, plateaus: bool = True) -> DataFrame:
    """(key, peak): the beats of whole recordings, as ``dsp.r_peaks`` finds them in one array.

    One pass over slabs with a halo gives every sample's envelope, and at its local maxima the
    highest sample nearby; the height comes from the recording's exact 90th percentile; of
    maxima too close together the higher stays, across slab edges too (``spaced_peaks``). The
    middle of a plateau is exact for up to ``PLATEAU`` equal values; without ``plateaus`` there is no beat on one.
    """
    length, reach, distance = dsp.beat_geometry(fs)

    def candidates(x: np.ndarray, first: int) -> list[pa.Array]:
        env = dsp.slope_energy(x, length)
        places = np.full(len(x), -1, np.int64)
        for p in dsp.maxima(env, plateaus):
            low = max(0, p - reach)
            near = x[low : p + reach + 1]
            if not np.isnan(near).all():
                places[p] = first + low + np.nanargmax(near)
        return [pa.array(np.append(env, 0.0), mask=np.arange(len(x)) == len(x) - 1), pa.array(places, mask=places < 0)]

    columns = [StructField("_env", DoubleType()), StructField("peak", LongType())]
    halo = length + reach + PLATEAU
    env = slabs(df.select(*key, pos, value), key, pos, value, halo, columns, candidates, max(block, halo)).where("_env IS NOT NULL")
    env = materialise(env.select(*key, pos, "_env", "peak"), "envelope")
    height = exact_quantiles(env, key, "_env", {"_p90": 0.9}, count="_n")
    maxima = lookup(env.where("peak IS NOT NULL"), height, key, "_n", ["_p90"])
    high = maxima.where(F.col("_env") >= F.greatest(F.col("_p90") * 0.30, F.lit(1e-4))).drop("_p90")
    return spaced_peaks(high, key, pos, "_env", distance).select(*key, "peak").distinct()


def spaced_peaks(peaks: DataFrame, key: list[str], pos: str, height: str, distance: int) -> DataFrame:
    """The rows that stay when, from the highest down, each clears all others closer than ``distance``; of equal ones the later goes first.

    A row that is the highest within its distance stays whatever happens elsewhere, and clears
    its surroundings; that settles most rows with two looks at neighbours. What is left falls
    into runs without such a gap, decided one by one.
    """
    near = lambda w: w.rangeBetween(-(distance - 1), distance - 1)
    rank = F.struct(height, pos)
    judged = neighbourhood(peaks, key, pos, distance, {"_top": lambda w: F.max(rank).over(near(w))})
    judged = materialise(judged.withColumn("_first", rank == F.col("_top")).drop("_top"), "champions")
    judged = materialise(neighbourhood(judged, key, pos, distance, {"_cleared": lambda w: F.max("_first").over(near(w))}), "cleared")
    rest, at = judged.where(~F.col("_cleared")), F.struct(pos)
    chunk = F.floor(F.col(pos) / (1 << 16))
    rest = scan(rest, key, [pos], chunk, {"_before": previous(F.col(pos), at)})
    gap = F.when(F.col(pos) - F.col("_before") < distance, 0).otherwise(1)
    rest = scan(rest.withColumn("_new", gap), key, [pos], chunk, {"_run": running_sum(F.col("_new"))})
    given = peaks.columns

    def decide(group: pa.Table) -> pa.Table:
        group = group.sort_by(pos)
        return group.filter(pa.array(dsp.spaced(group.column(pos).to_numpy(), group.column(height).to_numpy(), distance))).select(given)

    kept = rest.groupBy(*key, "_run").applyInArrow(decide, peaks.schema)
    return judged.where("_first").select(*peaks.columns).union(kept)


def local_maxima(df: DataFrame, key: list[str], pos: str, value: str) -> DataFrame:
    """Rows strictly above both neighbours; the ends of a series do not count."""
    near = neighbourhood(df, key, pos, 1, {"_l": lambda w: F.lag(value).over(w), "_r": lambda w: F.lead(value).over(w)})
    return near.where((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r"))).drop("_l", "_r")


def hrv_time_domain(
    df: DataFrame, key: list[str], order: list[str], chunk: Column, beat: Column,
    valid: tuple[float, float] = C.RR_VALID_MS, nn_step: float = C.NN_STEP_MS, per_minute: float = 60000.0,
) -> DataFrame:
    """Time-domain variability per key from a table of beats.

    ``beat`` is the beat time in the unit of ``valid``. Implausible intervals are left out
    before successive differences are taken, unless fewer than two would remain; both
    variants are aggregated in one pass and chosen at the end.
    """
    at = F.struct(*order)
    beats = df.withColumn("_t", beat)
    rr = scan(beats, key, order, chunk, {"_t0": previous(F.col("_t"), at)}).withColumn("_rr", F.col("_t") - F.col("_t0"))
    rr = rr.withColumn("_ok", F.when((F.col("_rr") >= valid[0]) & (F.col("_rr") <= valid[1]), F.col("_rr")))
    rr = scan(
        rr, key, order, chunk,
        {
            "_rr0": last_valid(F.col("_rr"), at, inclusive=False),
            "_ok0": last_valid(F.col("_ok"), at, inclusive=False),
        },
    )
    aggs = [F.count(F.lit(1)).alias("_beats"), F.count("_ok").alias("_kept")]
    for tag, x, x0 in (("all", F.col("_rr"), F.col("_rr0")), ("ok", F.col("_ok"), F.col("_ok0"))):
        d = x - x0
        hr = F.lit(per_minute) / x
        aggs += [
            F.avg(x).alias(f"_mean_{tag}"), F.stddev_samp(x).alias(f"_sd_{tag}"),
            F.avg(d * d).alias(f"_d2_{tag}"),
            F.avg(F.when(d.isNotNull(), (F.abs(d) > nn_step).cast("double"))).alias(f"_nn_{tag}"),
            F.avg(hr).alias(f"_hr_{tag}"), F.min(hr).alias(f"_lo_{tag}"), F.max(hr).alias(f"_hi_{tag}"),
        ]
    g = rr.groupBy(*key).agg(*aggs)

    def pick(name: str) -> Column:
        return F.when(F.col("_kept") >= 2, F.col(f"_{name}_ok")).otherwise(F.col(f"_{name}_all"))

    enough = F.col("_beats") >= 3
    values = [
        pick("mean"), F.coalesce(pick("sd"), F.lit(0.0)), F.coalesce(F.sqrt(pick("d2")), F.lit(0.0)),
        F.coalesce(pick("nn") * 100.0, F.lit(0.0)), pick("hr"), pick("lo"), pick("hi"), pick("hi") - pick("lo"),
    ]
    return g.select(
        *key, F.col("_beats").alias("n_beats"),
        *[F.when(enough, v).otherwise(d).alias(n) for n, v, d in zip(C.FEATURES_TIME, values, C.TIME_DEFAULTS)],
    )


def morphology(x: Column, entropy: Column | None = None) -> Column:
    """Struct of the shape statistics of an array column, in feature order."""

    def shape(v: Column, m: Column) -> Column:
        cols = [
            m["mean"], F.sqrt(m["m2"]), m["m2"], m["m3"] / F.pow(m["m2"], 1.5), m["m4"] / (m["m2"] * m["m2"]) - 3.0,
            A.peak_to_peak(v), A.zero_crossing_rate(v),
        ]
        if entropy is not None:
            cols.append(entropy)
        return F.struct(*[c.alias(n) for c, n in zip(cols, C.FEATURES_STAT)])

    return let(x, lambda v: let(A.moments(v), lambda m: shape(v, m)))


def oximetry(df: DataFrame, key: list[str], spo2: Column, ppg: Column, threshold: float = C.DESATURATION) -> DataFrame:
    """Saturation statistics and perfusion index per key, with the defaults for no data; NaN is missing."""
    spo2, ppg = present(spo2), present(ppg)
    g = df.groupBy(*key).agg(
        F.avg(spo2).alias("_m"), F.min(spo2).alias("_lo"), F.stddev_pop(spo2).alias("_sd"),
        F.avg((spo2 < threshold).cast("double")).alias("_des"),
        F.avg(ppg).alias("_dc"), (F.max(ppg) - F.min(ppg)).alias("_ac"),
    )
    perfusion = F.when(F.abs(F.col("_dc")) > 1e-4, F.col("_ac") / F.abs(F.col("_dc")) * 100.0)
    values = [F.col("_m"), F.col("_lo"), F.col("_sd"), F.col("_des"), perfusion]
    return g.select(*key, *[F.coalesce(v, F.lit(d)).alias(n) for n, v, d in zip(C.FEATURES_OXI, values, C.OXI_DEFAULTS)])
