"""Risk tiers, class labels and the rule-based fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe import constants as C


def risk_tier(p: Column, monitor: float = C.TIER_MONITOR, critical: float = C.TIER_CRITICAL) -> Column:
    return F.when(p >= critical, "CRITICAL").when(p >= monitor, "MONITOR").otherwise("LOW_RISK")


def predicted_class(p: Column) -> Column:
    """Argmax of (1 - p, p); a tie goes to the lower class."""
    return F.when(p > 0.5, 1).otherwise(0)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def class_label(cls: Column, labels: dict[int, str] = C.CLASS_LABELS) -> Column:
    out = F.concat(F.lit("Class "), cls.cast("string"))
    for code, text in labels.items():
        out = F.when(cls == code, text).otherwise(out)
    return out


def _rule(abnormal: Column, conf: float, p_yes: float, p_no: float, labels: dict[int, str]) -> Column:
    abnormal = F.coalesce(abnormal, F.lit(False))
    return F.struct(
        F.when(abnormal, 1).otherwise(0).alias("predicted_class"),
        F.when(abnormal, labels[1]).otherwise(labels[0]).alias("class_label"),
        F.lit(conf).alias("confidence_score"),
        F.when(abnormal, p_yes).otherwise(p_no).alias("pathology_probability"),
        F.when(abnormal, "CRITICAL").otherwise("LOW_RISK").alias("risk_tier"),
    )


def vitals_rule(bpm: Column, spo2: Column, bpm_low: float = 50.0, bpm_high: float = 115.0, spo2_low: float = 90.0) -> Column:
    """Prediction from device vitals when no model is loaded."""
    return _rule((bpm < bpm_low) | (bpm > bpm_high) | (spo2 < spo2_low), 0.94, 0.91, 0.05, C.VITALS_LABELS)


def hrv_rule(hr: Column, rmssd: Column, hr_low: float = 45.0, hr_high: float = 120.0, rmssd_low: float = 15.0) -> Column:
    """Prediction from heart-rate variability when no model is loaded."""
    hr = F.coalesce(hr, F.lit(72.0))
    rmssd = F.coalesce(rmssd, F.lit(35.0))
    return _rule((hr < hr_low) | (hr > hr_high) | (rmssd < rmssd_low), 0.88, 0.85, 0.12, C.CLASS_LABELS)


def alert_level(tier: Column, leads_off: Column) -> Column:
    return (
        F.when(leads_off, "LEADS_OFF")
        .when(tier.isin("CRITICAL", "MONITOR"), tier)
        .otherwise("NORMAL")
    )


def age_cohort(age: Column) -> Column:
    return F.when(age.isNull(), "UNKNOWN").when(age >= 65, "Senior (>=65)").otherwise("Non-Senior (<65)")
