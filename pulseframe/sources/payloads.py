"""JSON payloads: device telemetry and prediction requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe import constants as C

TELEMETRY = (
    "device_id string, fs double, leads_off boolean, bpm double, spo2 double, temperature_c double, signal array<double>"
)


def telemetry(value: Column) -> Column:
    """Struct of a telemetry packet; absent fields, or a broken payload, take the defaults."""
    p = F.from_json(value, TELEMETRY)
    fields = [F.coalesce(p[k], F.lit(v)).alias(k) for k, v in C.TELEMETRY_DEFAULTS.items()]
    return F.struct(*fields, F.coalesce(p["signal"], F.array().cast("array<double>")).alias("signal"))


def _numbers(value: Column, path: str) -> Column:
    """Array of doubles under ``path``: not an array -> NULL, not a number -> NULL element."""
    text = F.get_json_object(value, path)
    items = F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>"))
    return F.transform(items, lambda x: x.try_cast("double"))


def _is_list(value: Column, path: str) -> Column:
    """False where something is sent under ``path`` that is not a list; absent and null are fine."""
    text = F.get_json_object(value, path)
    return text.isNull() | F.trim(text).startswith("[")


def request(value: Column) -> Column:
    """Struct of a prediction request: signal form, feature map or feature list.

    ``ppg_form`` and ``spo2_form`` are false for a channel that was sent but is not a list.
    """
    feats = F.get_json_object(value, "$.features")
    mapped = F.when(F.trim(feats).startswith("{"), F.from_json(feats, "map<string,string>"))
    fs = F.get_json_object(value, "$.fs")
    return F.struct(
        _numbers(value, "$.signal").alias("signal"),
        F.when(fs.isNull(), C.ECG_FS).otherwise(fs.try_cast("double")).alias("fs"),
        F.transform_values(mapped, lambda _, v: v.try_cast("double")).alias("features"),
        _numbers(value, "$.features").alias("feature_list"),
        _numbers(value, "$.ppg_signal").alias("ppg"), _numbers(value, "$.spo2_signal").alias("spo2"),
        _is_list(value, "$.ppg_signal").alias("ppg_form"), _is_list(value, "$.spo2_signal").alias("spo2_form"),
    )
