"""Validation, branch and triage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import quality, sensors, triage
from pulseframe.functions.arrays import lead_rank
from pulseframe.operators import validation
from pulseframe.operators.series import last_valid, scan, time_chunk
from pulseframe.plans.registry import SCORED, query, with_
from pulseframe.plans.roles import ORDER, embeddings, events, r, scored, stamp
from pulseframe.sources.tables import table


@query("schema_check", """
WITH h AS (SELECT DISTINCT user_id, event_type FROM events),
c AS (SELECT user_id, list(event_type) AS present FROM h GROUP BY user_id)
SELECT user_id, len(list_filter(['click', ' VIEW ', 'Purchase', 'refund'], lambda x: NOT list_contains(present, lower(trim(x))))) AS n_missing,
  array_to_string(list_filter(['click', ' VIEW ', 'Purchase', 'refund'], lambda x: NOT list_contains(present, lower(trim(x)))), ',') AS missing
FROM c""")
def schema_check(spark, folder):
    """Channels present per device against a required list (collect_set of five known values)."""
    have = events(spark, folder, "user_id", "event_type").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    required = F.array(*[F.lit(x) for x in ("click", " VIEW ", "Purchase", "refund")])
    gone = validation.missing_columns(F.col("present"), required)
    return have.select("user_id", F.size(gone).alias("n_missing"), F.concat_ws(",", gone).alias("missing"))


@query("fs_check", """
SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*)::DOUBLE AS fs, abs(count(*) - 2.0) > 0.5 AS mismatch
FROM events GROUP BY 1, 2""")
def fs_check(spark, folder):
    per_day = events(spark, folder, "user_id", "ts").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("fs"))
    return per_day.withColumn("mismatch", validation.fs_mismatch(F.col("fs"), F.lit(2.0)))


@query("signal_range_check", """
WITH s AS (SELECT user_id, CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'inf'::DOUBLE WHEN event_type = 'error' AND user_id % 3 = 1 THEN NULL
                                ELSE value END AS v FROM events),
g AS (SELECT user_id, count(*) AS n, count(*) FILTER (isinf(v)) AS n_inf, count(*) FILTER (v IS NULL) AS n_nan,
        min(v) AS lo, max(v) AS hi FROM s GROUP BY user_id),
m AS (SELECT user_id, n, CASE WHEN n = 0 THEN 'Signal array is empty.'
   WHEN n_inf > 0 THEN printf('Signal contains %d infinite values.', n_inf)
   WHEN n_nan > 0 THEN printf('Signal contains %d NaN values (NaN not permitted).', n_nan)
   WHEN lo < 30 OR hi > 240 THEN printf('Heart rate [%.1f, %.1f] bpm outside physiological range [30, 240] bpm.', lo, hi)
   ELSE 'Valid signal' END AS message FROM g)
SELECT user_id, n, message = 'Valid signal' AS ok, message FROM m""")
def signal_range_check(spark, folder):
    broken = F.col("event_type") == "error"
    v = (F.when(broken & (F.col("user_id") % 3 == 0), float("inf")).when(broken & (F.col("user_id") % 3 == 1), None)
         .otherwise(F.round(F.col("value"), 6)))
    df = events(spark, folder, "user_id", "event_type", "value").withColumn("v", v)
    return validation.signal_ranges(df, ["user_id"], "v", "HR").select("user_id", "n", "ok", "message")


_REQ_SQL = """
e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6) * CASE WHEN vec_id % 11 = 0 THEN 200 ELSE 1 END) AS x FROM embeddings),
req AS (SELECT vec_id,
   CASE WHEN vec_id % 13 = 0 THEN NULL
        WHEN vec_id % 17 = 0 THEN list_transform(range(0, 128), lambda i: 'nan'::DOUBLE)
        ELSE flatten(list_transform(range(0, 1 + vec_id % 4), lambda i: x)) || CASE WHEN vec_id % 7 = 0 THEN ['inf'::DOUBLE] ELSE []::DOUBLE[] END END AS signal,
   (vec_id * 37 % 2500)::DOUBLE AS fs, [(35 + vec_id % 70)::DOUBLE, 98.0] AS spo2 FROM e),
v AS (SELECT *, len(signal) AS n, list_filter(signal, lambda a: NOT isnan(a)) AS valid FROM req)"""


@query("request_rules", "WITH " + _REQ_SQL.strip() + """
SELECT vec_id, CASE
  WHEN signal IS NULL THEN 'Payload must contain either ''signal'' (array of floats) or ''features'' (dict/array).'
  WHEN n < 100 THEN printf('Signal is too short (%d samples). Minimum is 100.', n)
  WHEN n > 50000 THEN 'Signal exceeds maximum allowed length (50000 samples).'
  WHEN len(list_filter(signal, lambda a: isinf(a))) > 0 THEN 'Signal contains invalid infinite (Inf) values.'
  WHEN len(valid) = 0 THEN 'Signal consists entirely of NaN values.'
  WHEN list_min(valid) < -10 OR list_max(valid) > 10 THEN printf('Signal amplitude [%.2f, %.2f] mV exceeds physical ECG range.', list_min(valid), list_max(valid))
  WHEN fs < 20 OR fs > 2000 THEN 'Sampling frequency ' || fs || ' Hz is outside allowable medical device range [20, 2000] Hz.'
  WHEN spo2[1] < 40 OR spo2[1] > 100 THEN 'SpO2 values outside physiological range [40%, 100%].' END AS error
FROM v""")
def request_rules(spark, folder):
    i = F.col("vec_id")
    scale = F.when(i % 11 == 0, 200.0).otherwise(1.0)
    x = F.transform("x", lambda a: F.round(a, 6) * scale)
    tail = F.when(i % 7 == 0, F.array(F.lit(float("inf")))).otherwise(F.array().cast("array<double>"))
    signal = (
        F.when(i % 13 == 0, None)
        .when(i % 17 == 0, F.array_repeat(F.lit(float("nan")), 128))
        .otherwise(F.concat(F.flatten(F.array_repeat(x, (1 + i % 4).cast("int"))), tail))
    )
    req = embeddings(spark, folder).select(
        "vec_id", signal.alias("signal"), (i * 37 % 2500).cast("double").alias("fs"),
        F.lit(None).cast("array<double>").alias("ppg"), F.array((35 + i % 70).cast("double"), F.lit(98.0)).alias("spo2"),
    )
    return req.select("vec_id", quality.request_error(F.col("signal"), F.col("fs"), F.col("ppg"), F.col("spo2")).alias("error"))


@query("leads_off_branch", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'ALERT_LEADS_OFF' ELSE 'SUCCESS' END AS status,
  CASE WHEN event_type = 'error' THEN 'MONITOR' WHEN value < 50 OR value > 115 THEN 'CRITICAL' ELSE 'LOW_RISK' END AS tier,
  CASE WHEN event_type = 'error' THEN 50 ELSE 1 END AS n_samples FROM events""")
def leads_off_branch(spark, folder):
    df = events(spark, folder, "event_id", "event_type", "value")
    off = F.col("event_type") == "error"
    rule = triage.vitals_rule(F.col("value"), F.lit(98.0))
    flat = F.array_repeat(F.lit(0.0), 50)
    return df.select(
        "event_id", F.when(off, C.LEADS_OFF_STATUS).otherwise("SUCCESS").alias("status"),
        F.when(off, "MONITOR").otherwise(rule["risk_tier"]).alias("tier"),
        F.size(F.when(off, flat).otherwise(F.array("value"))).alias("n_samples"),
    )


@query("vitals_rule_triage", """
SELECT event_id, CASE WHEN bad THEN 1 ELSE 0 END AS predicted_class, CASE WHEN bad THEN 'Arrhythmia / Abnormal' ELSE 'Normal Sinus Rhythm' END AS class_label,
  0.94::DOUBLE AS confidence_score, CASE WHEN bad THEN 0.91 ELSE 0.05 END::DOUBLE AS pathology_probability, CASE WHEN bad THEN 'CRITICAL' ELSE 'LOW_RISK' END AS risk_tier
FROM (SELECT event_id, value < 50 OR value > 115 OR 85 + user_id % 15 < 90 AS bad FROM events)""")
def vitals_rule_triage(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "value")
    return df.select("event_id", triage.vitals_rule(F.col("value"), 85 + F.col("user_id") % 15).alias("p")).select("event_id", "p.*")


@query("hrv_rule_triage", """
SELECT event_id, CASE WHEN bad THEN 1 ELSE 0 END AS predicted_class,
  CASE WHEN bad THEN 'Arrhythmia / Cardiac Abnormality' ELSE 'Normal Sinus Rhythm' END AS class_label, 0.88::DOUBLE AS confidence_score,
  CASE WHEN bad THEN 0.85 ELSE 0.12 END::DOUBLE AS pathology_probability, CASE WHEN bad THEN 'CRITICAL' ELSE 'LOW_RISK' END AS risk_tier
FROM (SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN value END, 72) < 45 OR coalesce(CASE WHEN event_type <> 'error' THEN value END, 72) > 120
        OR user_id % 40 < 15 AS bad FROM events)""")
def hrv_rule_triage(spark, folder):
    df = events(spark, folder, "event_id", "user_id", "event_type", "value")
    hr = F.when(F.col("event_type") != "error", F.col("value"))
    return df.select("event_id", triage.hrv_rule(hr, F.col("user_id") % 40).alias("p")).select("event_id", "p.*")


@query("triage_tiers", """
WITH scored AS (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS p, CASE WHEN (n_chars % 1000) / 1000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS yhat FROM documents)
SELECT doc_id, p, yhat AS predicted_class, CASE yhat WHEN 1 THEN 'Arrhythmia / Cardiac Abnormality' ELSE 'Normal Sinus Rhythm' END AS class_label,
  round(greatest(p, 1 - p), 4) AS confidence, CASE WHEN p >= 0.70 THEN 'CRITICAL' WHEN p >= 0.35 THEN 'MONITOR' ELSE 'LOW_RISK' END AS risk_tier
FROM scored""")
def triage_tiers(spark, folder):
    p = F.col("p")
    docs = table(spark, folder, "documents", "doc_id", "n_chars")
    return docs.select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p")).select(
        "doc_id", "p", triage.predicted_class(p).alias("predicted_class"),
        triage.class_label(triage.predicted_class(p)).alias("class_label"),
        F.round(triage.confidence(p), 4).alias("confidence"), triage.risk_tier(p).alias("risk_tier"),
    )


@query("alert_actions", """
WITH a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'LEADS_OFF' WHEN value >= 70 THEN 'CRITICAL' WHEN value >= 35 THEN 'MONITOR' ELSE 'NORMAL' END AS level FROM events),
d(level, alarm, action) AS (VALUES ('CRITICAL', true, 'Physician Alert Dispatch'), ('MONITOR', false, 'Nursing Review'),
   ('LEADS_OFF', true, 'Check Electrode Pads'), ('NORMAL', false, 'Passive Monitoring'))
SELECT event_id, level, alarm, action FROM a JOIN d USING (level)""")
def alert_actions(spark, folder):
    df = events(spark, folder, "event_id", "event_type", "value")
    level = triage.alert_level(triage.risk_tier(F.col("value") / 100), F.col("event_type") == "error")
    actions = spark.createDataFrame([(k, *v) for k, v in C.ALERT_ACTIONS.items()], "level string, alarm boolean, action string")
    # four fixed rows
    return df.select("event_id", level.alias("level")).join(F.broadcast(actions), "level").select("event_id", "level", "alarm", "action")


@query("label_join", """
SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 END, 0) AS is_abnormal, l.doc_id IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def label_join(spark, folder):
    docs = table(spark, folder, "documents", "doc_id")
    marks = table(spark, folder, "labels").select(
        "doc_id", F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("is_abnormal"))
    return docs.join(marks, "doc_id", "left").select(
        "doc_id", F.coalesce("is_abnormal", F.lit(0)).alias("is_abnormal"), F.col("is_abnormal").isNotNull().alias("labelled"))


@query("primary_lead", """
WITH c AS (SELECT user_id, CASE WHEN user_id % 7 = 0 AND event_type IN ('purchase', 'view') THEN 'aux' ELSE event_type END AS lead, min((ts, event_id)) AS seen FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE lead WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, seen) AS rn FROM c)
SELECT user_id, lead FROM k WHERE rn = 1""")
def primary_lead(spark, folder):
    """'purchase' plays the preferred lead and 'view' the second choice; else the first channel seen.

    On some devices both channels carry another name, so that every branch occurs.
    """
    renamed = (F.col("user_id") % 7 == 0) & F.col("event_type").isin("purchase", "view")
    df = events(spark, folder, "event_id", "ts", "user_id", "event_type").withColumn("lead", F.when(renamed, "aux").otherwise(F.col("event_type")))
    return df.groupBy("user_id").agg(F.min_by("lead", F.struct(lead_rank(F.col("lead"), ["purchase", "view"]).alias("k"), "ts", "event_id")).alias("lead"))


@query("adc_to_mv", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_returnflag = 'R' OR l_linenumber = 7 THEN 0.0
  ELSE (((l_partkey % 4096) / 4095.0::DOUBLE * 3.3::DOUBLE) - 1.65::DOUBLE) * 1000.0::DOUBLE / 1100.0::DOUBLE END, 6) + 0.0 AS mv FROM lineitem""")
def adc_to_mv(spark, folder):
    df = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    off = sensors.leads_off((F.col("l_returnflag") == "R").cast("int"), (F.col("l_linenumber") == 7).cast("int"))
    mv = sensors.adc_to_mv(F.col("l_partkey") % 4096, off)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", r(mv).alias("mv"))


@query("vitals_carry_forward", """
WITH e AS (SELECT event_id, ts, user_id, CASE WHEN value > 20 AND value < 45 THEN value END AS t,
   CASE WHEN value * 1000 > 50000 THEN least(greatest(110.0 - 25.0 * (30000 / (value * 1000)), 85.0), 100.0) END AS s FROM events)
SELECT event_id, user_id, last_value(t IGNORE NULLS) OVER w AS temperature_c, round(coalesce(last_value(s IGNORE NULLS) OVER w, 98.0), 6) AS spo2
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def vitals_carry_forward(spark, folder):
    df = events(spark, folder, "event_id", "ts", "user_id", "value").select(
        "event_id", "ts", "user_id", sensors.plausible_temperature(F.col("value")).alias("t"),
        sensors.spo2_estimate(F.col("value") * 1000, F.lit(30000.0)).alias("s"),
    )
    at = F.struct(*ORDER)
    out = scan(df, ["user_id"], ORDER, time_chunk("ts"),
               {"temperature_c": last_valid(F.col("t"), at), "spo2": last_valid(F.col("s"), at)})
    return out.select("event_id", "user_id", "temperature_c", r(F.coalesce("spo2", F.lit(98.0))).alias("spo2"))
