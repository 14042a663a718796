"""File-format queries, over files that Spark first derives from the driver tables."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import arrays as A
from pulseframe.functions import dsp, quality, triage
from pulseframe.operators import fairness, requests
from pulseframe.plans.deidentify import SALT, _pseudonym_sql
from pulseframe.plans.registry import EMB, SIG, query, with_
from pulseframe.plans.roles import embeddings, events, r, signal
from pulseframe.plans.waveforms import detrend_sql, filter_sql, hrv_arrays_sql, peaks_sql, ratios_sql, scale_sql, shape_sql
from pulseframe.session import scratch
from pulseframe.sources import manifest as manifests
from pulseframe.sources import payloads, sensor_csv, wfdb
from pulseframe.sources.files import locate
from pulseframe.sources.tables import table

SEGMENT = 4096  # samples per derived record, so that no record outgrows a row
FOLDERS = 256  # that the records are dealt to, so that no folder holds the files of all
CODES = {"view": 1, "click": 5, "purchase": 8, "signup": 9, "error": 14}


def encode_212(samples: np.ndarray) -> bytes:
    a, b = (samples & 0xFFF).T
    return np.stack([a & 0xFF, a >> 8 | (b >> 8) << 4, b & 0xFF], axis=1).astype(np.uint8).tobytes()


def encode_beats(deltas: list[int], codes: list[int]) -> bytes:
    words = [c << 10 | d for d, c in zip(deltas, codes)] + [0]
    return b"".join(int(w).to_bytes(2, "little") for w in words)


def _write(folder: str, gap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = locate(folder)
        made = set()
        for b in batches:
            for row in b.itertuples(index=False):
                place = f"{inner}/{crc32(row.record_id.encode()) % FOLDERS:03d}"
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                files = {"hea": row.header.encode(), "atr": encode_beats([gap] * len(row.codes), list(row.codes))}
                if row.has_data:
                    files["dat"] = encode_212(np.stack([np.asarray(row.a), np.asarray(row.b)], axis=1).astype(np.int64))
                for ext, content in files.items():
                    with fs.open_output_stream(f"{place}/{row.record_id}.{ext}") as f:
                        f.write(content)
            yield b[["record_id"]]

    return run


def wfdb_folder(spark, folder: str, broken: bool = False, gap: int = 300) -> str:
    """Write every device's samples as WFDB records of up to ``SEGMENT`` frames, with a beat every ``gap`` samples, and name their folders.

    ``broken`` leaves out the signal file of records that begin with a lost sample.
    """
    out = scratch(spark, "wfdb")
    fs, inner = locate(out)
    fs.create_dir(inner, recursive=True)
    code = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    rows = signal(spark, folder).select(
        F.concat_ws("_", "user_id", F.floor(F.col("idx") / SEGMENT)).alias("record_id"), "user_id",
        F.struct("idx", (F.floor(F.col("v") * 100) % 4096 - 2048).cast("int").alias("a"),
                 (F.col("event_id") % 4096 - 2048).cast("int").alias("b"), code[F.col("event_type")].alias("code")).alias("s"))
    recs = rows.groupBy("record_id", "user_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    u = F.col("user_id")
    header = F.format_string(
        "%s 2 360 %d\n%s.dat 212 200(1024)/mV 11 1024 0 0 0 MLII\n%s.dat 212 100 11 1024 0 0 0 V5\n# %d %s 1085 1629 x1\n# Aldomet, call 555-123-4567\n",
        "record_id", F.size("s"), "record_id", "record_id", (20 + u % 60).cast("int"), F.when(u % 2 == 0, "M").otherwise("F"))
    recs.select(
        "record_id", header.alias("header"), (~F.lit(broken) | (F.col("s.code")[0] != CODES["error"])).alias("has_data"), F.col("s.a").alias("a"), F.col("s.b").alias("b"), F.col("s.code").alias("codes"),
    ).mapInPandas(_write(out, gap), "record_id string").write.format("noop").mode("overwrite").save()
    return f"{out}/*"


_REC = with_(SIG) + """, rec AS (SELECT *, user_id || '_' || idx // 4096 AS record_id, idx % 4096 AS i,
  (floor(v * 100) % 4096 - 2048)::INT AS a, (event_id % 4096 - 2048)::INT AS b FROM sig)
"""


@query("wfdb_headers", _REC + """
SELECT record_id, 2 AS n_channels, 360.0::DOUBLE AS fs, count(*) AS n_samples, (20 + user_id % 60)::INT AS age, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
  'Aldomet, call 555-123-4567' AS medications, 'MLII,V5' AS leads, 200.0::DOUBLE AS gain0, 1024 AS baseline1 FROM rec GROUP BY record_id, user_id""")
def wfdb_headers(spark, folder):
    h = wfdb.read_headers(spark, wfdb_folder(spark, folder))
    return h.select("record_id", "n_channels", "fs", "n_samples", "age", "sex", "medications", F.concat_ws(",", "channels.desc").alias("leads"),
                    F.col("channels")[0]["gain"].alias("gain0"), F.col("channels")[1]["baseline"].alias("baseline1"))


@query("wfdb_signals", _REC + """
SELECT record_id, 'MLII' AS channel, i, round((a - 1024) / 200.0::DOUBLE, 6) AS mv FROM rec
UNION ALL SELECT record_id, 'V5', i, round((b - 1024) / 100.0::DOUBLE, 6) FROM rec""")
def wfdb_signals(spark, folder):
    blocks = wfdb.read_signals(spark, wfdb_folder(spark, folder), block=64)
    flat = blocks.select("record_id", "channel", "start", F.posexplode("samples").alias("k", "v"))
    return flat.select("record_id", "channel", (F.col("start") + F.col("k")).alias("i"), r(F.col("v")).alias("mv"))


@query("wfdb_beats", _REC + """
SELECT record_id, (i + 1) * 300 AS sample_idx, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 9 ELSE 14 END AS code FROM rec""")
def wfdb_beats(spark, folder):
    return wfdb.read_beats(spark, wfdb_folder(spark, folder))


@query("wfdb_records", _REC + f"""
SELECT record_id, {_pseudonym_sql('record_id')} AS patient_pseudonym, 360.0::DOUBLE AS fs, count(*) AS frames, 2 AS n_channels, count(*) AS n_beats, (20 + user_id % 60)::INT AS age,
  CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex, 'Aldomet, call [REDACTED_PHONE]' AS medications, 'WFDB_212' AS source_format
FROM rec GROUP BY record_id, user_id HAVING arg_min(event_type, i) <> 'error'""")
def wfdb_records(spark, folder):
    return wfdb.read_records(spark, wfdb_folder(spark, folder, broken=True), SALT)[0]


@query("record_blocks", _REC.rstrip() + f""",
n AS (SELECT record_id, user_id, count(*) AS frames, arg_min(event_type, i) = 'error' AS broken FROM rec GROUP BY 1, 2),
bt AS (SELECT record_id, least((i + 1) // 16, (frames - 1) // 16) AS blk, i + 1 AS s, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 5 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 9 ELSE 14 END AS code FROM rec JOIN n USING (record_id)),
bb AS (SELECT record_id, blk, count(*) AS n_beats, min(s) AS first_beat, max(s) AS last_beat, sum(code) AS codes FROM bt GROUP BY 1, 2),
sg AS (SELECT record_id, i // 16 AS blk, count(*) AS n, round(avg((a - 1024) / 200.0::DOUBLE), 6) AS mean_mlii, round(max((b - 1024) / 100.0::DOUBLE), 6) AS top_v5 FROM rec GROUP BY 1, 2)
SELECT record_id, {_pseudonym_sql('record_id')} AS patient_pseudonym, blk::BIGINT AS block_idx, (blk * 16)::BIGINT AS start, sg.n::INT AS n, mean_mlii, top_v5, coalesce(n_beats, 0)::INT AS n_beats, first_beat, last_beat, codes::BIGINT AS codes,
  (20 + user_id % 60)::INT AS age, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex
FROM sg JOIN n USING (record_id) LEFT JOIN bb USING (record_id, blk) WHERE NOT broken""")
def record_blocks(spark, folder):
    """Signals, beats and headers of all complete records, block by block."""
    b = wfdb.read_blocks(spark, wfdb_folder(spark, folder, broken=True, gap=1), SALT, block=16)
    at = F.col("beats.sample_idx")
    return b.select(
        "record_id", "patient_pseudonym", "block_idx", "start", "n", r(A.mean(F.col("signals")["MLII"])).alias("mean_mlii"), r(F.array_max(F.col("signals")["V5"])).alias("top_v5"),
        F.size("beats").alias("n_beats"), F.array_min(at).alias("first_beat"), F.array_max(at).alias("last_beat"),
        F.when(F.size("beats") > 0, F.aggregate("beats.code", F.lit(0).cast("long"), lambda s, c: s + c)).alias("codes"), "age", "sex")


_COHORTS = """pk AS (SELECT user_id, idx // 25 AS packet, avg(v) AS m, bool_or(event_type = 'error')::INT AS y FROM sig GROUP BY 1, 2),
h AS (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex, CASE WHEN 20 + user_id % 60 >= 65 THEN 'Senior (>=65)' ELSE 'Non-Senior (<65)' END AS age_cohort FROM events),
c AS (SELECT y, (m > 50)::INT AS yhat, sex, age_cohort FROM pk JOIN h USING (user_id)),
a AS (SELECT 'sex' AS attribute, sex AS grp, y, yhat FROM c UNION ALL SELECT 'age_cohort', age_cohort, y, yhat FROM c UNION ALL SELECT 'sex * age_cohort', sex || ' / ' || age_cohort, y, yhat FROM c)"""


def cohort_windows(spark, folder):
    """Packets of 25 samples with a lost one as truth and their mean as answer, and the demographics of their record's header."""
    rows = signal(spark, folder).withColumn("record_id", F.concat_ws("_", "user_id", F.floor(F.col("idx") / SEGMENT)))
    packets_ = rows.groupBy("record_id", F.floor(F.col("idx") / 25).alias("packet")).agg(F.avg("v").alias("m"), F.max((F.col("event_type") == "error").cast("int")).alias("y"))
    heads = wfdb.read_headers(spark, wfdb_folder(spark, folder)).select("record_id", "sex", triage.age_cohort(F.col("age")).alias("age_cohort"))
    return packets_.join(heads, "record_id").withColumn("yhat", (F.col("m") > 50).cast("int"))


@query("fairness_cohorts", with_(SIG, _COHORTS) + """
SELECT attribute, grp, count(*) AS sample_count, round_even(avg(yhat), 4) AS selection_rate, round_even(coalesce(avg(yhat) FILTER (y = 1), 0.0), 4) AS true_positive_rate,
  round_even(coalesce(avg(yhat) FILTER (y = 0), 0.0), 4) AS false_positive_rate FROM a GROUP BY 1, 2""")
def fairness_cohorts(spark, folder):
    """Sex, age cohort and their crossing from one aggregate over windows and record headers."""
    rates = fairness.cohort_rates(cohort_windows(spark, folder), ["sex", "age_cohort"], "y", "yhat")
    return fairness.subgroup_report(rates).drop("tpr_defined", "specificity")


@query("fairness_cohort_audit", with_(SIG, _COHORTS) + """,
g AS (SELECT attribute, grp, avg(yhat) AS sel, coalesce(avg(yhat) FILTER (y = 1), 0.0) AS tpr, coalesce(avg(yhat) FILTER (y = 0), 0.0) AS fpr FROM a GROUP BY 1, 2),
au AS (SELECT attribute, CASE WHEN max(sel) > 1e-6 THEN min(sel) / max(sel) ELSE 1.0 END AS di, max(tpr) - min(tpr) AS td, max(fpr) - min(fpr) AS fd FROM g GROUP BY 1)
SELECT attribute, round_even(di, 4) AS disparate_impact, round_even(td, 4) AS tpr_disparity, round_even(fd, 4) AS fpr_disparity, di >= 0.80 AND td <= 0.15 AS is_fair_80_percent_rule FROM au""")
def fairness_cohort_audit(spark, folder):
    rates = fairness.cohort_rates(cohort_windows(spark, folder), ["sex", "age_cohort"], "y", "yhat")
    return fairness.audit(rates).drop("all_tpr_defined")


@query("ingest_rejects", _REC + "SELECT record_id, 'WFDB binary data file not found' AS reason FROM rec WHERE i = 0 AND event_type = 'error'")
def ingest_rejects(spark, folder):
    return wfdb.read_records(spark, wfdb_folder(spark, folder, broken=True), SALT)[1]


@query("csv_ingest", """
SELECT event_id, user_id, CASE WHEN event_type <> 'error' AND event_id % 97 <> 0 THEN value END AS value, 2.0::DOUBLE AS fs FROM events""")
def csv_ingest(spark, folder):
    out = scratch(spark, "csv")
    value = F.when(F.col("event_id") % 97 == 0, "n/a").when(F.col("event_type") != "error", F.col("value").cast("string")).otherwise("")
    events(spark, folder).select(F.col("ts").alias("timestamp"), "event_id", "user_id", value.alias("value")).write.option("header", "true").csv(out)
    df = sensor_csv.read(spark, out, fs=2.0)
    return df.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "value", "fs")


@query("csv_records", f"""SELECT count(*) AS row_count, {_pseudonym_sql("'SUBJ-999'")} AS patient_pseudonym, 'CSV' AS source_format FROM events""")
def csv_records(spark, folder):
    """Metadata of the derived CSV files, added up over the part files of one subject."""
    out = scratch(spark, "csv")
    events(spark, folder, "ts", "value").select(F.col("ts").alias("timestamp"), "value").write.option("header", "true").csv(out)
    per_file = sensor_csv.describe(sensor_csv.read(spark, out), F.lit("SUBJ-999"), SALT)
    return per_file.groupBy("patient_pseudonym", "source_format").agg(F.sum("row_count").alias("row_count"))


@query("file_manifest", """
SELECT regexp_extract(filename, '([^/]+)$', 1) AS file, size::BIGINT AS length, sha256(content) AS sha256
FROM read_blob('/root/testdata/sf0.01/*.parquet')""")
def file_manifest(spark, folder):
    return manifests.manifest(spark, folder, "*.parquet")


_TELEMETRY_FIELDS = """event_id, CASE WHEN event_id % 3 = 0 THEN 'ESP32_UNKNOWN' ELSE 'dev-' || user_id END AS device_id,
  CASE WHEN event_id % 5 = 0 THEN 72.0 ELSE regexp_extract(props, '(\\d+)', 1)::DOUBLE END AS bpm, 98.0::DOUBLE AS spo2, 36.5::DOUBLE AS temperature_c,
  125.0::DOUBLE AS fs, event_type = 'error' AS leads_off, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS n_samples"""


def packets(df):
    """props as a telemetry payload: 'k' is the pulse; some fields are left out, some packets are broken."""
    i = F.col("event_id")
    body = F.concat(
        F.when(i % 5 == 0, '{"x": 0').otherwise(F.regexp_replace(F.regexp_replace("props", '"k"', '"bpm"'), r"\}$", "")),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(', "device_id": "dev-'), F.col("user_id"), F.lit('"'))),
        F.when(F.col("event_type") == "error", ', "leads_off": true').otherwise(""),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit(', "signal": ['), F.col("value"), F.lit(", 0.5]"))),
        F.lit("}"),
    )
    return df.withColumn("payload", body)


def parsed_packets(df):
    p = packets(df).select("event_id", "ts", payloads.telemetry(F.col("payload")).alias("p"))
    return p.select("event_id", "ts", "p.*")


@query("telemetry_parse", f"SELECT {_TELEMETRY_FIELDS} FROM events")
def telemetry_parse(spark, folder):
    df = parsed_packets(events(spark, folder, "event_id", "ts", "user_id", "event_type", "value", "props"))
    return df.select("event_id", "device_id", "bpm", "spo2", "temperature_c", "fs", "leads_off", F.size("signal").alias("n_samples"))


def request_payloads(spark, folder):
    """Embeddings as request bodies: signal form, feature forms, and broken ones."""
    i = F.col("vec_id")
    x = F.concat_ws(",", F.transform("x", lambda v: F.round(v, 6).cast("string")))
    body = (
        F.when(i % 5 == 0, F.concat(F.lit('{"features": {"rmssd_ms": '), (i % 40).cast("string"), F.lit(', "mean_hr_bpm": 70.5}}')))
        .when(i % 5 == 1, F.concat(F.lit('{"features": ['), x, F.lit("]}")))
        .when(i % 5 == 2, F.concat(F.lit('{"signal": ['), x, F.lit(',"oops"], "fs": 125}')))
        .otherwise(F.concat(F.lit('{"signal": ['), x, F.lit(","), x, F.lit('], "fs": 100, "spo2_signal": [97, 98.5]}')))
    )
    return embeddings(spark, folder).select("vec_id", body.alias("payload"))


@query("request_parse", """
SELECT vec_id, CASE vec_id % 5 WHEN 2 THEN 65 WHEN 3 THEN 128 WHEN 4 THEN 128 END::INT AS n_signal, CASE vec_id % 5 WHEN 2 THEN 125.0 WHEN 3 THEN 100.0 WHEN 4 THEN 100.0 ELSE 360.0 END::DOUBLE AS fs,
  CASE WHEN vec_id % 5 = 0 THEN (vec_id % 40)::DOUBLE END AS rmssd_ms, CASE WHEN vec_id % 5 = 1 THEN 64 END::INT AS n_list, vec_id % 5 = 2 AS has_bad_value FROM embeddings""")
def request_parse(spark, folder):
    q = request_payloads(spark, folder).select("vec_id", payloads.request(F.col("payload")).alias("q"))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return q.select("vec_id", n("q.signal").alias("n_signal"), "q.fs", F.col("q.features")["rmssd_ms"].alias("rmssd_ms"),
                    n("q.feature_list").alias("n_list"), F.coalesce(F.exists("q.signal", lambda v: v.isNull()), F.lit(False)).alias("has_bad_value"))


@query("request_channels", """
SELECT vec_id, CASE vec_id % 8 WHEN 0 THEN 'Invalid ppg_signal format or length.' WHEN 1 THEN 'Invalid spo2_signal format or length.' WHEN 2 THEN 'Invalid spo2_signal format or length.'
  WHEN 5 THEN 'Feature ''b'' must be numeric.' WHEN 6 THEN 'SpO2 values outside physiological range [40%, 100%].' WHEN 7 THEN 'Features list must contain only numeric floats.' END AS error FROM embeddings""")
def request_channels(spark, folder):
    """Channels that are text, a number, null or absent, and broken features, on bodies that are fine otherwise."""
    extra = [
        '"features": {"a": 1}, "ppg_signal": "abc"', '"features": {"a": 1}, "spo2_signal": "abc"', '"features": {"a": 1}, "spo2_signal": 97', '"features": {"a": 1}, "ppg_signal": null',
        '"features": {"a": 1}', '"features": {"a": 1, "b": "x", "c": "y"}', '"features": {"a": 1}, "spo2_signal": [30, 99]', '"features": [1, "x"]',
    ]
    body = F.concat(F.lit("{"), F.element_at(F.array(*[F.lit(e) for e in extra]), (F.col("vec_id") % 8 + 1).cast("int")), F.lit("}"))
    q = table(spark, folder, "embeddings", "vec_id").select("vec_id", payloads.request(body).alias("q")).select("vec_id", "q.*")
    names = ("signal", "fs", "ppg", "spo2", "features", "feature_list", "ppg_form", "spo2_form")
    return q.select("vec_id", quality.request_error(*[F.col(c) for c in names]).alias("error"))


def _scoring_sql() -> str:
    n, fs = 128, 100.0
    chain = ",\n".join(v.strip() for v in (
        EMB, "req AS (SELECT vec_id, flatten([list_transform(x, lambda v: round(v, 6)), list_transform(x, lambda v: round(v, 6))]) AS x FROM emb WHERE vec_id % 5 >= 3)",
        filter_sql(*dsp.bandpass_coefficients(fs, *C.ECG_BAND), "req", "bp", n), detrend_sql("bp", "det", n, fs), scale_sql("det", "cl"),
        ratios_sql("cl", "q", n, fs), shape_sql("cl", "sh"), peaks_sql("cl", "pk", n, fs), hrv_arrays_sql("pk", "cl", "hv", fs),
        f"""k0 AS (SELECT sh.vec_id, m4 / (v2 * v2) - 3 AS kurt, baseline, emg FROM sh JOIN q USING (vec_id)),
k AS (SELECT *, concat_ws('; ', CASE WHEN kurt < 2 THEN '{C.REASON_LOW_KURTOSIS}' WHEN kurt > 60 THEN '{C.REASON_HIGH_KURTOSIS}' END,
   CASE WHEN baseline > 0.60 THEN printf('{C.REASON_BASELINE}', baseline * 100) END, CASE WHEN emg > 0.35 THEN printf('{C.REASON_EMG}', emg * 100) END) AS reasons,
   round(0.5 * (CASE WHEN kurt >= 2 THEN least((kurt - 2) / 8, 1.0) ELSE 0.0 END) + 0.5 * greatest(0.0, 1.0 - (baseline * 1.2 + emg * 1.5)), 4) AS score FROM k0)""",
        """d AS (SELECT vec_id, 1.0::DOUBLE AS score, CASE vec_id % 5 WHEN 0 THEN 70.5 END::DOUBLE AS hr, CASE vec_id % 5 WHEN 0 THEN vec_id % 40 END::DOUBLE AS rmssd,
             NULL::DOUBLE AS sdnn, NULL::DOUBLE AS spo2 FROM emb WHERE vec_id % 5 < 2
             UNION ALL SELECT vec_id, score, mean_hr_bpm, rmssd_ms, sdnn_ms, 97.75 FROM k JOIN hv USING (vec_id) WHERE reasons = '')""",
        "t AS (SELECT *, coalesce(hr, 72) < 45 OR coalesce(hr, 72) > 120 OR coalesce(rmssd, 35) < 15 AS bad FROM d)"))
    none = ", ".join(f"NULL::{t} AS {c}" for c, t in (
        ("class_code", "INT"), ("clinical_condition", "VARCHAR"), ("calibrated_confidence", "DOUBLE"), ("pathology_probability", "DOUBLE"),
        ("triage_risk_tier", "VARCHAR"), ("heart_rate_bpm", "DOUBLE"), ("rmssd_ms", "DOUBLE"), ("sdnn_ms", "DOUBLE"), ("spo2_percent", "DOUBLE")))
    return f"""WITH RECURSIVE {chain}
SELECT vec_id, 'INVALID' AS status, 'Signal is too short (65 samples). Minimum is 100.' AS message, NULL AS rejection_reason, NULL::DOUBLE AS kurtosis, NULL::DOUBLE AS quality_score, {none} FROM emb WHERE vec_id % 5 = 2
UNION ALL SELECT vec_id, 'REJECTED_LOW_QUALITY', '{C.REQUEST_REJECTED}', reasons, round(kurt, 6), score, {none} FROM k WHERE reasons <> ''
UNION ALL SELECT vec_id, 'SUCCESS', NULL, NULL, NULL, score, bad::INT, CASE WHEN bad THEN '{C.CLASS_LABELS[1]}' ELSE '{C.CLASS_LABELS[0]}' END, 0.88, CASE WHEN bad THEN 0.85 ELSE 0.12 END,
   CASE WHEN bad THEN 'CRITICAL' ELSE 'LOW_RISK' END, round(coalesce(hr, 0), 1) + 0.0, round(coalesce(rmssd, 0), 1) + 0.0, round(coalesce(sdnn, 0), 1) + 0.0, round(coalesce(spo2, 98), 1) + 0.0 FROM t"""


@query("request_scoring", _scoring_sql())
def request_scoring(spark, folder):
    """Every request ends as INVALID, REJECTED_LOW_QUALITY or SUCCESS."""
    out = requests.score(request_payloads(spark, folder), "payload", ["vec_id"])
    return out.withColumn("kurtosis", r(F.col("metrics")["kurtosis_sqi"])).drop("metrics")
