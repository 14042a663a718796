"""Windows, conditioning, quality and features over the long signal layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import quality, triage
from pulseframe.operators import conditioning, ecg, features, windows
from pulseframe.operators.beats import hrv_from_times
from pulseframe.operators.lookup import lookup
from pulseframe.operators.quantiles import exact_quantiles
from pulseframe.operators.series import indexed, time_chunk
from pulseframe.plans.registry import EMB, SIG, WIN, query, with_
from pulseframe.plans.roles import ORDER, embeddings, events, missing, r, signal, stamp
from pulseframe.sources.sinks import materialise

KEY = ["user_id"]
N, STEP = 20, 10


def windowed(spark: SparkSession, folder: str) -> DataFrame:
    return windows.sliding(signal(spark, folder, total="total"), N, STEP)


def window_stats(df: DataFrame) -> DataFrame:
    """Moments of each window and the two stand-in noise ratios."""
    v = F.col("v")
    return df.groupBy("user_id", "w").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(v).alias("variance"), F.kurtosis(v).alias("kurt"),
        F.skewness(v).alias("skew"), F.avg((F.abs(v) <= 5).cast("double")).alias("baseline"),
        F.avg((v > 150).cast("double")).alias("emg"),
    )


STATS_SQL = WIN + """,
mom AS (SELECT user_id, w, count(*) AS n, avg(v) AS mu, var_pop(v) AS variance, kurtosis_pop(v) AS kurt,
               avg(CASE WHEN abs(v) <= 5 THEN 1.0 ELSE 0.0 END) AS baseline,
               avg(CASE WHEN v > 150 THEN 1.0 ELSE 0.0 END) AS emg
        FROM win GROUP BY user_id, w),
stats AS (SELECT m.*, s.m3 / pow(m.variance, 1.5) AS skew FROM mom m JOIN (
            SELECT w.user_id, w.w, avg(pow(w.v - m.mu, 3)) AS m3 FROM win w JOIN mom m USING (user_id, w)
            GROUP BY 1, 2) s USING (user_id, w)),
verdict AS (SELECT *, concat_ws('; ',
    CASE WHEN kurt < 2 THEN 'Low kurtosis: lacking distinct QRS complexes or excessive white noise.'
         WHEN kurt > 60 THEN 'Extreme kurtosis: high-amplitude impulse artifact / motion spike.' END,
    CASE WHEN baseline > 0.60 THEN printf('Severe baseline wander (%.1f%% low-frequency power).', baseline * 100) END,
    CASE WHEN emg > 0.35 THEN printf('Severe muscle/EMG noise (%.1f%% high-frequency power).', emg * 100) END) AS reasons
  FROM stats)"""


@query("sliding_windows", with_(WIN) + """
SELECT user_id, w::BIGINT AS w, (w * 10)::BIGINT AS start_idx, (w * 10 + 20)::BIGINT AS end_idx, count(*) AS n,
       arg_min(v, idx) AS first_v, arg_max(v, idx) AS last_v
FROM win GROUP BY user_id, w""")
def sliding_windows(spark, folder):
    return windowed(spark, folder).groupBy("user_id", "w").agg(
        (F.col("w") * STEP).alias("start_idx"), (F.col("w") * STEP + N).alias("end_idx"),
        F.count(F.lit(1)).alias("n"), F.min_by("v", "idx").alias("first_v"), F.max_by("v", "idx").alias("last_v"),
    )


@query("tumbling_packets", with_(SIG) + """
SELECT user_id, (idx // 25)::BIGINT AS packet, count(*) AS n, min(v) AS min_v, max(v) AS max_v, round(avg(v), 6) AS avg_v
FROM sig GROUP BY user_id, idx // 25""")
def tumbling_packets(spark, folder):
    return windows.tumbling(signal(spark, folder), 25).groupBy("user_id", "packet").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), r(F.avg("v")).alias("avg_v")
    )


@query("event_sliding_counts", """
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS n
FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS b) x
GROUP BY 1, 2""")
def event_sliding_counts(spark, folder):
    counts = windows.event_time_counts(events(spark, folder, "ts", "event_type"), "ts", ["event_type"], "10 minutes", "5 minutes")
    return counts.select(stamp(F.col("window_start")).alias("window_start"), "event_type", "n")


@query("align_secondary", """
WITH ch AS (
  SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS idx
  FROM events WHERE event_type IN ('click', 'view')),
len AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS l1, count(*) FILTER (event_type = 'view') AS l2 FROM ch GROUP BY 1),
w AS (SELECT c.user_id, c.idx // 3 AS w, l1, l2,
        greatest(least(l2 - 1, floor(c.idx * l2 / l1::DOUBLE)), 0)::BIGINT AS lo, least(l2, floor((c.idx + 6) * l2 / l1::DOUBLE))::BIGINT AS hi
      FROM ch c JOIN len USING (user_id) WHERE event_type = 'click' AND c.idx % 3 = 0 AND c.idx + 6 <= l1)
SELECT w.user_id, w.w::BIGINT AS w, w.lo, w.hi, count(c.idx) AS n, round(avg(c.value), 6) AS avg_v
FROM w LEFT JOIN ch c ON c.user_id = w.user_id AND c.event_type = 'view' AND c.idx >= w.lo AND c.idx < w.hi
GROUP BY 1, 2, 3, 4""")
def align_secondary(spark, folder):
    df = events(spark, folder).where(F.col("event_type").isin("click", "view"))
    out = windows.align_secondary(df, KEY, ORDER, "ts", F.col("event_type") == "click", F.col("value"), 6, 3)
    return out.select("user_id", "w", "lo", "hi", "n", r(F.col("avg_v")).alias("avg_v"))


@query("impute_linear", with_(SIG) + """,
gaps AS (SELECT *, last_value(CASE WHEN vm IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS pi, last_value(vm IGNORE NULLS) OVER b AS pv,
            first_value(CASE WHEN vm IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ni, first_value(vm IGNORE NULLS) OVER f AS nv
         FROM sig WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, idx, round(CASE WHEN vm IS NOT NULL THEN vm WHEN pi IS NOT NULL AND ni IS NOT NULL
         THEN pv + (nv - pv) * (idx - pi) / (ni - pi) ELSE coalesce(pv, nv, 0.0) END, 6) AS v
FROM gaps""")
def impute_linear(spark, folder):
    df = signal(spark, folder)
    df = df.withColumn("vm", missing(df))
    out = conditioning.impute_linear(df, KEY, ORDER, time_chunk("ts"), "vm", "idx", "out")
    return out.select("user_id", "idx", r(F.col("out")).alias("v"))


@query("impute_median", with_(SIG) + """,
med AS (SELECT user_id, quantile_cont(vm, 0.5) AS med FROM sig GROUP BY user_id)
SELECT event_id, user_id, round(coalesce(vm, med, 0.0), 6) AS v FROM sig JOIN med USING (user_id)""")
def impute_median(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "event_type", "value").withColumnRenamed("value", "v")
    df = df.withColumn("vm", missing(df))
    return conditioning.impute_median(df, KEY, "vm", "out").select("event_id", "user_id", r(F.col("out")).alias("v"))


@query("impute_zero", with_(SIG) + "SELECT event_id, user_id, coalesce(vm, 0.0) AS v FROM sig")
def impute_zero(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "event_type", "value").withColumnRenamed("value", "v")
    return df.select("event_id", "user_id", conditioning.impute_zero(missing(df)).alias("v"))


@query("robust_scale", with_(SIG) + """,
q AS (SELECT user_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, stddev_pop(v) AS sd
      FROM sig GROUP BY user_id)
SELECT event_id, user_id, round(CASE WHEN q3 - q1 < 1e-6 THEN (v - q2) / (sd + 1e-6) ELSE (v - q2) / (q3 - q1) END, 6) + 0.0 AS scaled
FROM sig JOIN q USING (user_id)""")
def robust_scale(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "value")
    return conditioning.robust_scale(df, KEY, "value", "out").select("event_id", "user_id", r(F.col("out")).alias("scaled"))


@query("median_detrend", with_(SIG) + """,
near AS (SELECT user_id, idx, v, list(v) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS l FROM sig)
SELECT user_id, idx, round(v - list_sort(l || list_transform(range(101 - len(l)), lambda i: 0.0::DOUBLE))[51], 6) + 0.0 AS detrended FROM near""")
def median_detrend(spark, folder):
    out = conditioning.median_detrend(signal(spark, folder).select("user_id", "idx", "v"), KEY, "idx", "v", C.BASELINE_MAX_KERNEL, "out")
    return out.select("user_id", "idx", r(F.col("out")).alias("detrended"))


WIDTH = 54  # 0.15 s at 360 Hz
ENV_SQL = SIG + """,
sq AS (SELECT user_id, idx, pow(lead(v) OVER w - v, 2) AS d FROM sig WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
env AS (SELECT user_id, idx, sum(d) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 27 PRECEDING AND 26 FOLLOWING) / 54 AS env FROM sq WHERE d IS NOT NULL)"""


@query("energy_envelope", with_(ENV_SQL) + "SELECT user_id, idx, round(env, 6) AS env FROM env")
def energy_envelope(spark, folder):
    out = features.energy_envelope(signal(spark, folder).select("user_id", "idx", "v"), KEY, "idx", "v", WIDTH)
    return out.select("user_id", "idx", r(F.col("env")).alias("env"))


@query("peak_candidates", with_(ENV_SQL) + """,
th AS (SELECT user_id, greatest(quantile_cont(env, 0.9) * 0.30, 1e-4) AS th FROM env GROUP BY user_id),
nb AS (SELECT user_id, idx, env, lag(env) OVER w AS l, lead(env) OVER w AS r FROM env WINDOW w AS (PARTITION BY user_id ORDER BY idx))
SELECT user_id, idx, round(env, 6) AS env FROM nb JOIN th USING (user_id) WHERE env > l AND env > r AND env >= th""")
def peak_candidates(spark, folder):
    env = features.energy_envelope(signal(spark, folder).select("user_id", "idx", "v"), KEY, "idx", "v", WIDTH)
    env = materialise(env.select("user_id", "idx", "env"), "envelope")
    p90 = exact_quantiles(env, KEY, "env", {"p90": 0.9}, count="n")
    peaks = lookup(features.local_maxima(env, KEY, "idx", "env"), p90, KEY, "n", ["p90"])
    return peaks.where(F.col("env") >= F.greatest(F.col("p90") * 0.30, F.lit(1e-4))).select("user_id", "idx", r(F.col("env")).alias("env"))


@query("flatline_check", with_(STATS_SQL) + """
SELECT user_id, w::BIGINT AS w, n, round(variance, 6) AS variance,
  CASE WHEN n < 20 THEN 'Window duration is too short (< 1 sec).'
       WHEN variance < 1e-7 THEN 'Flatline or sensor disconnection detected.' ELSE 'ok' END AS status
FROM stats""")
def flatline_check(spark, folder):
    s = window_stats(windowed(spark, folder))
    v = quality.sqi_verdict(F.col("n"), F.lit(20.0), F.col("variance"), F.lit(3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return s.select("user_id", "w", "n", r(F.col("variance")).alias("variance"),
                    F.when(v["is_acceptable"], "ok").otherwise(v["rejection_reason"]).alias("status"))


def verdicts(spark, folder):
    s = window_stats(windowed(spark, folder))
    return s.withColumn("verdict", quality.sqi_verdict(
        F.col("n"), F.lit(20.0), F.col("variance"), F.col("kurt"), F.col("skew"), F.col("baseline"), F.col("emg")))


@query("sqi_verdict", with_(STATS_SQL) + """
SELECT user_id, w::BIGINT AS w, reasons = '' AS is_acceptable,
  round(0.5 * (CASE WHEN kurt >= 2 THEN least(greatest((kurt - 2) / 8, 0.0), 1.0) ELSE 0.0 END)
        + 0.5 * greatest(0.0, 1.0 - (baseline * 1.2 + emg * 1.5)), 6) AS quality_score,
  CASE WHEN reasons = '' THEN 'Acceptable signal quality' ELSE reasons END AS rejection_reason,
  round(kurt, 6) AS kurtosis_sqi, round(skew, 6) + 0.0 AS skewness_sqi
FROM verdict""")
def sqi_verdict(spark, folder):
    return verdicts(spark, folder).select(
        "user_id", "w", "verdict.is_acceptable", r(F.col("verdict.quality_score")).alias("quality_score"),
        "verdict.rejection_reason", r(F.col("verdict.metrics")["kurtosis_sqi"]).alias("kurtosis_sqi"),
        r(F.col("verdict.metrics")["skewness_sqi"]).alias("skewness_sqi"),
    )


@query("sqi_gate_counts", with_(STATS_SQL) + """
SELECT user_id, count(*) FILTER (reasons = '') AS accepted, count(*) FILTER (reasons <> '') AS rejected FROM verdict GROUP BY user_id""")
def sqi_gate_counts(spark, folder):
    ok = F.col("verdict.is_acceptable")
    return verdicts(spark, folder).groupBy("user_id").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query("sqi_gate_observed", with_(STATS_SQL) + """
SELECT count(*) FILTER (reasons = '') AS accepted, count(*) FILTER (reasons <> '') AS rejected, count(*) FILTER (reasons = '') AS written FROM verdict""")
def sqi_gate_observed(spark, folder):
    """Accepted windows are written; the counters come from the same pass."""
    accepted, counters = ecg.gated(verdicts(spark, folder), F.col("verdict.is_acceptable"))
    kept = materialise(accepted.select("user_id", "w"), "accepted")
    seen = counters.get
    return kept.groupBy().agg(F.lit(seen["accepted"]).cast("long").alias("accepted"), F.lit(seen["rejected"]).cast("long").alias("rejected"), F.count(F.lit(1)).alias("written"))


def hrv_sql(source: str, keys: str) -> str:
    """HRV over beats given as (keys, ts, event_id), intervals in minutes."""
    return f"""
b AS (SELECT {keys}, ts, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY ts, event_id)) / 60000000.0::DOUBLE AS rr FROM {source}),
k AS (SELECT *, CASE WHEN rr BETWEEN 1 AND 2000 THEN rr END AS ok FROM b),
d AS (SELECT *, lag(rr) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS rr0 FROM k),
dk AS (SELECT {keys}, ts, event_id, ok - lag(ok) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS dok FROM k WHERE ok IS NOT NULL),
a AS (SELECT {keys}, count(*) AS n_beats, count(ok) AS kept, avg(rr) AS mean_all, avg(ok) AS mean_ok, stddev_samp(rr) AS sd_all, stddev_samp(ok) AS sd_ok,
        avg(pow(rr - rr0, 2)) AS d2_all, avg(CASE WHEN rr0 IS NULL OR rr IS NULL THEN NULL WHEN abs(rr - rr0) > 50 THEN 1.0 ELSE 0.0 END) AS nn_all,
        avg(60.0 / rr) AS hr_all, min(60.0 / rr) AS lo_all, max(60.0 / rr) AS hi_all,
        avg(60.0 / ok) AS hr_ok, min(60.0 / ok) AS lo_ok, max(60.0 / ok) AS hi_ok FROM d GROUP BY {keys}),
a2 AS (SELECT {keys}, avg(dok * dok) AS d2_ok, avg(CASE WHEN dok IS NULL THEN NULL WHEN abs(dok) > 50 THEN 1.0 ELSE 0.0 END) AS nn_ok FROM dk GROUP BY {keys}),
hrv AS (SELECT {keys}, n_beats,
   CASE WHEN n_beats < 3 THEN 800.0 WHEN kept >= 2 THEN mean_ok ELSE mean_all END AS mean_rr_ms,
   CASE WHEN n_beats < 3 THEN 0.0 WHEN kept >= 2 THEN coalesce(sd_ok, 0) ELSE coalesce(sd_all, 0) END AS sdnn_ms,
   CASE WHEN n_beats < 3 THEN 0.0 WHEN kept >= 2 THEN coalesce(sqrt(d2_ok), 0) ELSE coalesce(sqrt(d2_all), 0) END AS rmssd_ms,
   CASE WHEN n_beats < 3 THEN 0.0 WHEN kept >= 2 THEN coalesce(nn_ok * 100, 0) ELSE coalesce(nn_all * 100, 0) END AS pnn50,
   CASE WHEN n_beats < 3 THEN 75.0 WHEN kept >= 2 THEN hr_ok ELSE hr_all END AS mean_hr_bpm,
   CASE WHEN n_beats < 3 THEN 75.0 WHEN kept >= 2 THEN lo_ok ELSE lo_all END AS min_hr_bpm,
   CASE WHEN n_beats < 3 THEN 75.0 WHEN kept >= 2 THEN hi_ok ELSE hi_all END AS max_hr_bpm,
   CASE WHEN n_beats < 3 THEN 0.0 WHEN kept >= 2 THEN hi_ok - lo_ok ELSE hi_all - lo_all END AS hr_range_bpm
 FROM a LEFT JOIN a2 USING ({keys}))"""


HRV_COLS = ["mean_rr_ms", "sdnn_ms", "rmssd_ms", "pnn50", "mean_hr_bpm", "min_hr_bpm", "max_hr_bpm", "hr_range_bpm"]
HRV_ROUND = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in HRV_COLS)


@query("hrv_time_domain", "WITH " + hrv_sql("events", "user_id").lstrip() + f"\nSELECT user_id, n_beats, {HRV_ROUND} FROM hrv")
def hrv_time_domain(spark, folder):
    beats = events(spark, folder, "event_id", "ts", "user_id")
    # whole microseconds keep the intervals exact
    out = features.hrv_time_domain(
        beats, KEY, ORDER, time_chunk("ts"), F.unix_micros("ts").cast("double"),
        valid=(60e6, 2000 * 60e6), nn_step=50 * 60e6, per_minute=60.0 * 60e6)
    scale = {"mean_rr_ms", "sdnn_ms", "rmssd_ms"}
    return out.select("user_id", "n_beats", *[r(F.col(c) / 60e6 if c in scale else F.col(c)).alias(c) for c in HRV_COLS])


@query("spo2_ppg_features", """
SELECT user_id, round(avg(value), 6) AS spo2_mean, min(value) AS spo2_min, round(stddev_pop(value), 6) AS spo2_std,
  round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END), 6) AS spo2_desat_ratio,
  round(CASE WHEN abs(avg(value)) > 1e-4 THEN (max(value) - min(value)) / abs(avg(value)) * 100 ELSE 1.5 END, 6) AS ppg_perfusion_index
FROM events GROUP BY user_id""")
def spo2_ppg_features(spark, folder):
    df = events(spark, folder, "user_id", "value")
    out = features.oximetry(df, KEY, F.col("value"), F.col("value"), threshold=10.0)
    return out.select("user_id", *[(F.col(c) if c == "spo2_min" else r(F.col(c))).alias(c) for c in out.columns[1:]])


@query("morphology", with_(EMB) + """,
m AS (SELECT vec_id, x, list_avg(x) AS mu, list_var_pop(x) AS v2 FROM emb),
c AS (SELECT *, list_sum(list_transform(x, lambda e: pow(e - mu, 3))) / len(x) AS m3, list_sum(list_transform(x, lambda e: pow(e - mu, 4))) / len(x) AS m4 FROM m)
SELECT vec_id, round(mu, 6) + 0.0 AS stat_mean, round(sqrt(v2), 6) AS stat_std, round(v2, 6) AS stat_var, round(m3 / pow(v2, 1.5), 6) + 0.0 AS stat_skewness,
  round(m4 / (v2 * v2) - 3, 6) + 0.0 AS stat_kurtosis, round(list_max(x) - list_min(x), 6) AS stat_p2p_amp,
  round(len(list_filter(range(1, len(x)), lambda i: (x[i] > 0) <> (x[i + 1] > 0))) / len(x)::DOUBLE, 6) AS stat_zcr
FROM c""")
def morphology(spark, folder):
    df = embeddings(spark, folder)
    stats = df.select("vec_id", features.morphology(F.col("x")).alias("m")).select("vec_id", "m.*")
    return stats.select("vec_id", *[r(F.col(c)).alias(c) for c in stats.columns[1:]])


FLAGSHIP_SQL = with_(STATS_SQL, hrv_sql("win", "user_id, w").strip()) + """,
t AS (SELECT user_id, w, s.n, s.variance, s.kurt, reasons, h.* EXCLUDE (user_id, w),
   (mean_hr_bpm < 0.1 OR mean_hr_bpm > 2.0 OR rmssd_ms < 400) AS abn FROM verdict s JOIN hrv h USING (user_id, w))
SELECT user_id, w::BIGINT AS w, n, round(variance, 6) AS variance, round(kurt, 6) AS kurt, reasons = '' AS is_acceptable,
  variance < 1e-7 AS is_flat, round(mean_hr_bpm, 6) AS mean_hr_bpm, round(rmssd_ms, 6) AS rmssd_ms, round(sdnn_ms, 6) AS sdnn_ms,
  CASE WHEN abn THEN 1 ELSE 0 END AS predicted_class, CASE WHEN abn THEN 'Arrhythmia / Cardiac Abnormality' ELSE 'Normal Sinus Rhythm' END AS class_label,
  CASE WHEN abn THEN 0.85 ELSE 0.12 END::DOUBLE AS pathology_probability, CASE WHEN abn THEN 'CRITICAL' ELSE 'LOW_RISK' END AS risk_tier
FROM t"""


@query("window_triage", FLAGSHIP_SQL)
def window_triage(spark, folder):
    """Flagship: windows -> quality -> beat variability -> rule triage.

    A window holds 20 rows, so all of its work happens on one collected, bounded array: a
    single shuffle after the indexing one, and no second pass for the beat intervals.
    """
    rows = windowed(spark, folder)
    stats = rows.groupBy("user_id", "w").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("variance"), F.kurtosis("v").alias("kurt"), F.skewness("v").alias("skew"),
        F.avg((F.abs(F.col("v")) <= 5).cast("double")).alias("baseline"), F.avg((F.col("v") > 150).cast("double")).alias("emg"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", F.unix_micros("ts").alias("t")))), lambda b: b["t"].cast("double")).alias("beats"),
    )
    verdict = quality.sqi_verdict(F.col("n"), F.lit(20.0), F.col("variance"), F.col("kurt"), F.col("skew"), F.col("baseline"), F.col("emg"))
    stats = stats.withColumn("ok", verdict["is_acceptable"])
    hrv = hrv_from_times(stats, "beats", lambda a, b: (b - a) / 60e6, valid=(1.0, 2000.0), nn_step=50.0, per_minute=60.0)
    out = hrv.withColumn("p", triage.hrv_rule(F.col("mean_hr_bpm"), F.col("rmssd_ms"), 0.1, 2.0, 400.0))
    return out.select(
        "user_id", "w", "n", r(F.col("variance")).alias("variance"), r(F.col("kurt")).alias("kurt"), F.col("ok").alias("is_acceptable"),
        (F.col("variance") < 1e-7).alias("is_flat"), r(F.col("mean_hr_bpm")).alias("mean_hr_bpm"), r(F.col("rmssd_ms")).alias("rmssd_ms"),
        r(F.col("sdnn_ms")).alias("sdnn_ms"), "p.predicted_class", "p.class_label", "p.pathology_probability", "p.risk_tier",
    )
