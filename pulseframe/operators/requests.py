"""Scoring a table (or stream) of prediction requests: one ordered outcome per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import dsp, quality, triage
from pulseframe.operators import ecg
from pulseframe.operators.beats import variability
from pulseframe.operators.model import RiskModel
from pulseframe.sources.payloads import request


def given_feature(name: str) -> Column:
    """A feature the client sent by name. The list form has no names: rules then use their defaults."""
    return F.col("features")[name]


def score(df: DataFrame, payload: str, keep: list[str], model: RiskModel | None = None) -> DataFrame:
    """INVALID, REJECTED_LOW_QUALITY or SUCCESS with the triage response, in one pass.

    Invalid requests hand NULL to the kernels, which skip them. With a fitted ``model`` (over
    the 26 features) the prediction is the model's: by name for feature maps, by position for
    lists; a request that lacks a feature falls back to the heart-rate rule.
    """
    parsed = df.select(*keep, request(F.col(payload)).alias("q")).select(*keep, "q.*")
    error = quality.request_error(*[F.col(c) for c in ("signal", "fs", "ppg", "spo2", "features", "feature_list", "ppg_form", "spo2_form")])
    checked = parsed.withColumn("_error", error)
    checked = checked.withColumn("_x", F.when(F.col("_error").isNull(), F.col("signal"))).drop("signal")
    cleaned = ecg.assess(ecg.clean_ecg(checked, "_x", "fs", "_clean"), "_clean", "fs")
    if model:
        found = ecg.extract(cleaned, "_clean", "fs", "ppg", "spo2")
    else:
        peaks = cleaned.withColumn("_peaks", dsp.r_peaks(F.col("_clean"), F.col("fs")))
        beats = variability(F.col("_peaks"), lambda a, b: (b - a) / F.col("fs") * 1000.0)
        oxygen = ecg.oximetry_struct(F.col("spo2"), F.col("ppg"))
        found = peaks.withColumn("_hrv", beats).withColumn("_oxi", oxygen).select("*", "_hrv.*", "_oxi.*")
    found = found.withColumn("_passed", F.col("_x").isNotNull() & F.col("sqi.is_acceptable"))

    invalid = F.col("_error").isNotNull()
    rejected = F.col("_x").isNotNull() & ~F.col("_passed")
    done = ~invalid & ~rejected
    value = {
        c: F.when(F.col("_passed"), F.col(c)).otherwise(given_feature(c))
        for c in ("mean_hr_bpm", "rmssd_ms", "sdnn_ms", "spo2_mean")
    }
    wanted = C.FEATURES if model else []
    vector = [F.when(F.col("_passed"), F.col(c)).otherwise(F.coalesce(given_feature(c), F.get("feature_list", F.lit(i)))) for i, c in enumerate(wanted)]
    slim = found.select(
        *keep, F.when(invalid, "INVALID").when(rejected, "REJECTED_LOW_QUALITY").otherwise("SUCCESS").alias("status"),
        F.when(invalid, F.col("_error")).when(rejected, C.REQUEST_REJECTED).alias("message"),
        F.when(rejected, F.col("sqi.rejection_reason")).alias("rejection_reason"), F.when(rejected, F.col("sqi.metrics")).alias("metrics"),
        F.when(~invalid, F.round(F.when(F.col("_x").isNull(), 1.0).otherwise(F.col("sqi.quality_score")), 4)).alias("quality_score"),
        *[F.when(done, v).alias(f"_{c}") for c, v in value.items()], *[F.when(done, v).alias(c) for c, v in zip(wanted, vector)],
    )

    def answer(c: Column) -> Column:
        return F.when(F.col("status") == "SUCCESS", c)

    def vital(name: str, default: float) -> Column:
        return answer(F.round(F.coalesce(F.col(f"_{name}"), F.lit(default)), 1) + 0.0)

    slim = slim.withColumn("_p", triage.hrv_rule(F.col("_mean_hr_bpm"), F.col("_rmssd_ms")))
    if model:
        slim = with_model(slim, model, "_p")
    return slim.select(
        *keep, "status", "message", "rejection_reason", "metrics", "quality_score",
        answer(F.col("_p.predicted_class")).alias("class_code"), answer(F.col("_p.class_label")).alias("clinical_condition"),
        answer(F.round("_p.confidence_score", 4)).alias("calibrated_confidence"),
        answer(F.round("_p.pathology_probability", 4)).alias("pathology_probability"),
        answer(F.col("_p.risk_tier")).alias("triage_risk_tier"),
        vital("mean_hr_bpm", 0.0).alias("heart_rate_bpm"), vital("rmssd_ms", 0.0).alias("rmssd_ms"),
        vital("sdnn_ms", 0.0).alias("sdnn_ms"), vital("spo2_mean", 98.0).alias("spo2_percent"),
    )


def with_model(df: DataFrame, model: RiskModel, rule: str) -> DataFrame:
    """``df`` with the struct ``rule`` replaced by the model's answer where all its features are known."""
    known = F.lit(True)
    for c in model.features:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    whole = df.select("*", known.alias("_known"))
    filled = whole.withColumns({c: F.when(F.col("_known"), F.col(c)).otherwise(0.0) for c in model.features})
    scored = model.score(filled)
    answer = F.struct("predicted_class", "class_label", F.col("confidence").alias("confidence_score"), "pathology_probability", "risk_tier")
    return scored.withColumn(rule, F.when(F.col("_known"), answer).otherwise(F.col(rule)))
