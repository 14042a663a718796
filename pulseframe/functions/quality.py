"""Quality verdicts and validation rules; the first failing rule gives the message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions.binding import let
from pulseframe.functions.rounding import message


def first_failure(rules: list[tuple[Column, Column | str]], ok: Column | str | None = None) -> Column:
    out = None
    for failed, text in rules:
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(failed, text) if out is None else out.when(failed, text)
    return out.otherwise(F.lit(ok) if isinstance(ok, str) else ok) if ok is not None else out


def sqi_verdict(n: Column, fs: Column, variance: Column, kurt: Column, skew: Column, baseline: Column, emg: Column) -> Column:
    """Accept/reject a window from its moments and spectral ratios."""
    short = n < fs.cast("int")
    flat = variance < C.FLATLINE_VARIANCE
    reasons = F.concat_ws(
        "; ",
        F.when(kurt < C.KURTOSIS_MIN, C.REASON_LOW_KURTOSIS).when(kurt > C.KURTOSIS_MAX, C.REASON_HIGH_KURTOSIS),
        F.when(baseline > C.BASELINE_RATIO_MAX, message(C.REASON_BASELINE, baseline * 100)),
        F.when(emg > C.EMG_RATIO_MAX, message(C.REASON_EMG, emg * 100)),
    )
    reason = let(
        F.when(short, C.REASON_SHORT).when(flat, C.REASON_FLAT).otherwise(reasons),
        lambda text: F.when(text == "", C.REASON_OK).otherwise(text),
    )
    kurt_score = F.when(kurt >= 2.0, F.least(F.greatest((kurt - 2.0) / 8.0, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    clean_score = F.greatest(F.lit(0.0), 1.0 - (baseline * 1.2 + emg * 1.5))
    score = F.when(short | flat, 0.0).otherwise(0.5 * kurt_score + 0.5 * clean_score)
    metrics = (
        F.when(short, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
        .when(flat, F.create_map(F.lit("variance"), variance))
        .otherwise(
            F.create_map(
                F.lit("kurtosis_sqi"), kurt, F.lit("skewness_sqi"), skew,
                F.lit("baseline_power_ratio"), baseline, F.lit("emg_power_ratio"), emg,
                F.lit("variance"), variance,
            )
        )
    )
    return let(
        reason,
        lambda text: F.struct(
            (text == C.REASON_OK).alias("is_acceptable"), score.alias("quality_score"),
            metrics.alias("metrics"), text.alias("rejection_reason"),
        ),
    )


def signal_range(kind: str, n: Column, n_inf: Column, n_nan: Column, low: Column, high: Column, allow_nan: bool = False) -> Column:
    """Message for a signal summarised as counts and extremes of its valid values."""
    rules = [
        (n == 0, "Signal array is empty."),
        (n_inf > 0, F.format_string("Signal contains %d infinite values.", n_inf)),
    ]
    if not allow_nan:
        rules.append((n_nan > 0, F.format_string("Signal contains %d NaN values (NaN not permitted).", n_nan)))
    rules.append((n_nan == n, "Signal consists entirely of NaNs."))
    limits = C.RANGE_RULES.get(kind.upper().replace("HEART_RATE", "HR"))
    if limits:
        rules.append(((low < limits[0]) | (high > limits[1]), message(limits[2], low, high)))
    return first_failure(rules, "Valid signal")


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def request_error(
    signal: Column, fs: Column, ppg: Column, spo2: Column, features: Column | None = None, feature_list: Column | None = None,
    ppg_form: Column | None = None, spo2_form: Column | None = None,
) -> Column:
    """First rule a prediction request breaks, or NULL.

    ``signal``/``ppg``/``spo2`` are arrays of doubles; a null element is a value that was not
    numeric. ``features`` is a map of doubles, ``feature_list`` an array. ``ppg_form`` and
    ``spo2_form`` tell whether the channel, where it was sent, was a list.
    """
    has_features = F.lit(False)
    for f in (features, feature_list):
        if f is not None:
            has_features = has_features | f.isNotNull()
    has_signal = signal.isNotNull()
    n = F.size(signal)
    valid = F.filter(signal, lambda x: ~F.isnan(x))
    low, high = F.array_min(valid), F.array_max(valid)
    rules = [
        (~has_features & ~has_signal, C.REQUEST_NO_PAYLOAD),
        (has_signal & (n < C.REQUEST_MIN_SAMPLES), F.format_string(C.REQUEST_SHORT, n)),
        (has_signal & (n > C.REQUEST_MAX_SAMPLES), C.REQUEST_LONG),
        (has_signal & F.exists(signal, lambda x: x.isNull()), C.REQUEST_NOT_NUMERIC),
        (has_signal & F.exists(signal, lambda x: F.abs(x) == float("inf")), C.REQUEST_INFINITE),
        (has_signal & (F.size(valid) == 0), C.REQUEST_ALL_NAN),
        (has_signal & ((low < -C.REQUEST_MV_LIMIT) | (high > C.REQUEST_MV_LIMIT)), message(C.REQUEST_AMPLITUDE, low, high)),
        (fs.isNull(), C.REQUEST_FS_TYPE),
        ((fs < C.REQUEST_FS_RANGE[0]) | (fs > C.REQUEST_FS_RANGE[1]), F.format_string(C.REQUEST_FS, fs.cast("string"))),
    ]
    if features is not None:
        bad = F.get(F.filter(F.map_entries(features), lambda e: e["value"].isNull() | ~_finite(e["value"])), F.lit(0))
        rules += [
            (bad.isNotNull() & bad["value"].isNull(), F.format_string(C.REQUEST_FEATURE_TYPE, bad["key"])),
            (bad.isNotNull(), F.format_string(C.REQUEST_FEATURE_FINITE, bad["key"])),
        ]
    if feature_list is not None:
        rules += [
            (F.exists(feature_list, lambda x: x.isNull()), C.REQUEST_LIST_TYPE),
            (~F.forall(feature_list, _finite), C.REQUEST_LIST_FINITE),
        ]
    spo2_valid = F.filter(spo2, lambda x: ~F.isnan(x))
    no_list = lambda form: F.lit(False) if form is None else ~form
    rules += [
        (no_list(ppg_form) | (F.size(ppg) > C.REQUEST_MAX_SAMPLES), C.REQUEST_PPG),
        (no_list(spo2_form) | (F.size(spo2) > C.REQUEST_MAX_SAMPLES), C.REQUEST_SPO2_FORM),
        ((F.array_min(spo2_valid) < C.REQUEST_SPO2_RANGE[0]) | (F.array_max(spo2_valid) > C.REQUEST_SPO2_RANGE[1]), C.REQUEST_SPO2),
    ]
    return first_failure(rules)
