"""De-identification as Catalyst expressions: no UDF, no row leaves the JVM."""

from __future__ import annotations

import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pulseframe import constants as C

SALT_CONF = "pulseframe.privacy.salt"
SALT_ENV = "PULSEFRAME_SALT"


def configured_salt(spark: SparkSession) -> str:
    """The deployment's secret; there is no default on purpose."""
    salt = spark.conf.get(SALT_CONF, None) or os.environ.get(SALT_ENV)
    if not salt:
        raise RuntimeError(f"set {SALT_CONF} or {SALT_ENV}")
    return salt


def _pads(salt: str) -> tuple[bytes, bytes]:
    import hashlib

    key = salt.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def hmac_sha256(message: Column, salt: str) -> Column:
    """Hex HMAC-SHA256, built from two nested ``sha2`` calls."""
    inner_pad, outer_pad = _pads(salt)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)


def pseudonym(identifier: Column, salt: str) -> Column:
    digest = hmac_sha256(F.trim(identifier.cast("string")), salt)
    return F.concat(F.lit(C.PSEUDONYM_PREFIX), F.upper(F.substring(digest, 1, C.PSEUDONYM_HEX)))


def jitter_hours(pseudonym_col: Column) -> Column:
    """Whole-hour shift of a patient, the same for all of the patient's records."""
    head = F.conv(F.substring(F.sha2(pseudonym_col, 256), 1, 8), 16, 10).cast("bigint")
    return head % (C.JITTER_HOURS_MAX - C.JITTER_HOURS_MIN) + C.JITTER_HOURS_MIN


def shift_timestamp(ts: Column, pseudonym_col: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + jitter_hours(pseudonym_col) * 3_600_000_000)


def scrub(text: Column, strict: bool = False) -> Column:
    """Replace direct identifiers in free text, most specific pattern first.

    ``strict`` makes the patterns Unicode-aware (accented names, non-Latin digits).
    """
    for name, pattern, tag in C.SCRUB_PATTERNS:
        if strict:
            pattern = "(?U)" + pattern
            if name == "name":
                pattern = pattern.replace("[A-Z][a-z]+", r"\p{Lu}\p{Ll}+")
        text = F.regexp_replace(text, pattern, tag)
    return text


def scrub_log(text: Column) -> Column:
    return F.regexp_replace(scrub(text), C.RAW_ARRAY_PATTERN, C.RAW_ARRAY_TAG)
