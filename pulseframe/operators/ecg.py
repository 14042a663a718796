"""Window-level work on array columns: cleaning, gating, the 26 features."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import arrays as A
from pulseframe.functions import dsp, quality
from pulseframe.functions.binding import let
from pulseframe.operators.beats import variability
from pulseframe.operators.features import morphology


def clean_ecg(df: DataFrame, x: str, fs: str, out: str, notch_hz: float = C.NOTCH_HZ) -> DataFrame:
    """Fill gaps, band-pass, mains notch, baseline removal, robust scale."""
    steps = [dsp.fill_kernel(), dsp.bandpass_kernel(*C.ECG_BAND), dsp.notch_kernel(notch_hz), dsp.detrend_kernel(), dsp.scale_kernel()]
    return df.withColumn(out, dsp.condition(F.col(x), F.col(fs), steps))


def clean_ppg(df: DataFrame, x: str, fs: str, out: str) -> DataFrame:
    steps = [dsp.fill_kernel(), dsp.bandpass_kernel(*C.PPG_BAND), dsp.scale_kernel()]
    return df.withColumn(out, dsp.condition(F.col(x), F.col(fs), steps))


def assess(df: DataFrame, x: str, fs: str, out: str = "sqi") -> DataFrame:
    """Quality verdict of each (cleaned) window."""
    n, rate = F.coalesce(F.size(x), F.lit(0)), F.col(fs)

    def verdict(m: Column, q: Column) -> Column:
        m2, m3, m4 = m["m2"], m["m3"], m["m4"]
        return quality.sqi_verdict(n, rate, m2, m4 / (m2 * m2) - 3.0, m3 / F.pow(m2, 1.5), q[0], q[1])

    ratios = df.withColumn("_r", dsp.noise_ratios(F.col(x), rate))
    return ratios.withColumn(out, let(A.moments(F.col(x)), lambda m: let(F.col("_r"), lambda q: verdict(m, q)))).drop("_r")


def gated(df: DataFrame, acceptable: Column, name: str = "gate") -> tuple[DataFrame, Observation]:
    """The acceptable rows, and counters of both kinds that are filled by whatever action runs over them.

    ``observation.get`` waits for the first one and has ``accepted`` and ``rejected``: no second pass.
    For plans of built-in expressions: Spark cannot ship an observation with Python kernels.
    """
    counters = Observation(f"{name}-{uuid.uuid4().hex}")
    ok = F.coalesce(acceptable, F.lit(False))
    seen = df.withColumn("_ok", ok).observe(counters, F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected"))
    return seen.where("_ok").drop("_ok"), counters


def oximetry_struct(spo2: Column | None, ppg: Column | None) -> Column:
    """Saturation and perfusion features of array columns, with defaults for missing channels."""
    none = [F.lit(d) for d in C.OXI_DEFAULTS]

    def saturation(s: Column) -> Column:
        got = [
            A.mean(s), F.array_min(s), F.sqrt(A.moment(A.centred(s), 2)),
            F.size(F.filter(s, lambda v: v < C.DESATURATION)) / F.size(s),
        ]
        some = F.coalesce(F.size(s) > 0, F.lit(False))
        return F.struct(*[F.when(some, g).otherwise(d).alias(c) for c, g, d in zip(C.FEATURES_OXI, got, none)])

    def perfusion(dc: Column) -> Column:
        return F.when(F.coalesce(dc > 1e-4, F.lit(False)), A.peak_to_peak(ppg) / dc * 100.0).otherwise(none[4])

    default = F.struct(*[d.alias(c) for c, d in zip(C.FEATURES_OXI[:4], none)])
    left = default if spo2 is None else let(F.filter(spo2, lambda v: v.isNotNull() & ~F.isnan(v)), saturation)
    right = none[4] if ppg is None else let(F.abs(A.mean(ppg)), perfusion)
    return let(left, lambda s: F.struct(*[s[c].alias(c) for c in C.FEATURES_OXI[:4]], right.alias(C.FEATURES_OXI[4])))


def extract(df: DataFrame, x: str, fs: str, ppg: str | None = None, spo2: str | None = None, plateaus: bool = True) -> DataFrame:
    """Add the 26 features, in vector order, to windows that are already cleaned."""
    rate = F.col(fs)
    found = df.withColumn("_beats", dsp.beats_and_entropy(F.col(x), rate, plateaus))
    found = found.withColumn("_freq", dsp.band_powers(F.col("_beats.peaks"), rate))
    parts = found.select(
        *df.columns,
        variability(F.col("_beats.peaks"), lambda a, b: (b - a) / rate * 1000.0).alias("_time"),
        let(F.col("_freq"), lambda p: F.struct(*[p[i].alias(n) for i, n in enumerate(C.FEATURES_FREQ)])).alias("_band"),
        morphology(F.col(x), F.col("_beats.entropy")).alias("_stat"),
        oximetry_struct(F.col(spo2) if spo2 else None, F.col(ppg) if ppg else None).alias("_oxi"),
    )
    return parts.select(*df.columns, "_time.*", "_band.*", "_stat.*", "_oxi.*")


def window_features(
    df: DataFrame, x: str, fs: str, ppg: str | None = None, spo2: str | None = None, gate: bool = True, plateaus: bool = True
) -> DataFrame:
    """Raw windows to features: clean, assess, drop rejected windows (``gate``), extract."""
    checked = assess(clean_ecg(df, x, fs, "_clean"), "_clean", fs)
    if gate:
        checked = checked.where("sqi.is_acceptable")
    return extract(checked, "_clean", fs, ppg, spo2, plateaus).drop("_clean")
