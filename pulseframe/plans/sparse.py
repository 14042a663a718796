"""The ordered operators on records with gaps: NULL devices, NULL times, NULL and NaN samples.

Every row must come back. Rows without a time come first in their device, and rows without a
device are one device.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import arrays, triage
from pulseframe.operators import conditioning, features, metrics, sessions, windows
from pulseframe.operators.series import indexed, time_chunk
from pulseframe.plans.registry import query
from pulseframe.plans.roles import ORDER, embeddings, events, r, stamp
from pulseframe.plans.streams import HORIZON, LIMIT
from pulseframe.session import scratch
from pulseframe.sources import manifest, sinks
from pulseframe.sources.tables import table
from pulseframe.streaming import device

_SPARSE = """sp AS (
  SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 103 <> 0 THEN ts END AS ts, event_type,
         CASE WHEN event_id % 107 = 0 OR event_id % 109 = 0 THEN NULL ELSE value END AS v FROM events),
ix AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1 AS idx FROM sp)"""


def sparse(spark, folder):
    i = F.col("event_id")
    return events(spark, folder).select(
        "event_id", F.when(i % 101 != 0, F.col("user_id")).alias("user_id"), F.when(i % 103 != 0, F.col("ts")).alias("ts"), "event_type",
        F.when(i % 107 == 0, None).when(i % 109 == 0, float("nan")).otherwise(F.col("value")).alias("v"),
    )


@query("sparse_index", f"""WITH {_SPARSE}
SELECT event_id, user_id, idx::BIGINT AS idx, count(*) OVER (PARTITION BY user_id) AS total FROM ix""")
def sparse_index(spark, folder):
    return indexed(sparse(spark, folder), ["user_id"], ORDER, time_chunk("ts"), total="total").select("event_id", "user_id", "idx", "total")


@query("sparse_windows", f"""WITH {_SPARSE},
t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS total FROM ix),
w AS (SELECT *, unnest([idx // 10 - 1, idx // 10]) AS w FROM t)
SELECT user_id, w::BIGINT AS w, count(*) AS n, count(v) AS n_valid, min(event_id) AS first_id FROM w WHERE w >= 0 AND w * 10 + 20 <= total GROUP BY 1, 2""")
def sparse_windows(spark, folder):
    rows = indexed(sparse(spark, folder), ["user_id"], ORDER, time_chunk("ts"), total="total")
    return windows.sliding(rows, 20, 10).groupBy("user_id", "w").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.isnan("v") & F.col("v").isNotNull()).alias("n_valid"), F.min("event_id").alias("first_id"))


@query("sparse_impute", f"""WITH {_SPARSE},
gaps AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS pi, last_value(v IGNORE NULLS) OVER b AS pv,
            first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ni, first_value(v IGNORE NULLS) OVER f AS nv
         FROM ix WINDOW b AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        f AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
med AS (SELECT user_id, quantile_cont(v, 0.5) AS med FROM sp GROUP BY 1)
SELECT event_id, g.user_id, round(CASE WHEN v IS NOT NULL THEN v WHEN pi IS NOT NULL AND ni IS NOT NULL THEN pv + (nv - pv) * (idx - pi) / (ni - pi)
    ELSE coalesce(pv, nv, 0.0) END, 6) AS linear, round(coalesce(v, med, 0.0), 6) AS median, coalesce(v, 0.0) AS zero
FROM gaps g JOIN med m ON g.user_id IS NOT DISTINCT FROM m.user_id""")
def sparse_impute(spark, folder):
    rows = indexed(sparse(spark, folder), ["user_id"], ORDER, time_chunk("ts"))
    linear = conditioning.impute_linear(rows, ["user_id"], ORDER, time_chunk("ts"), "v", "idx", "linear")
    both = conditioning.impute_median(linear, ["user_id"], "v", "median")
    return both.select("event_id", "user_id", r(F.col("linear")).alias("linear"), r(F.col("median")).alias("median"), conditioning.impute_zero(F.col("v")).alias("zero"))


@query("sparse_scale", f"""WITH {_SPARSE},
q AS (SELECT user_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, stddev_pop(v) AS sd FROM sp GROUP BY 1)
SELECT event_id, s.user_id, round(CASE WHEN q3 - q1 < 1e-6 THEN (v - q2) / (sd + 1e-6) ELSE (v - q2) / (q3 - q1) END, 6) + 0.0 AS scaled
FROM sp s JOIN q ON s.user_id IS NOT DISTINCT FROM q.user_id""")
def sparse_scale(spark, folder):
    out = conditioning.robust_scale(sparse(spark, folder), ["user_id"], "v", "out")
    return out.select("event_id", "user_id", r(F.col("out")).alias("scaled"))


@query("sparse_oximetry", f"""WITH {_SPARSE}
SELECT user_id, round(avg(v), 6) AS spo2_mean, min(v) AS spo2_min, round(stddev_pop(v), 6) AS spo2_std,
  round(avg(CASE WHEN v < 10 THEN 1.0 WHEN v >= 10 THEN 0.0 END), 6) AS spo2_desat_ratio,
  round(CASE WHEN abs(avg(v)) > 1e-4 THEN (max(v) - min(v)) / abs(avg(v)) * 100 ELSE 1.5 END, 6) AS ppg_perfusion_index
FROM sp GROUP BY user_id""")
def sparse_oximetry(spark, folder):
    out = features.oximetry(sparse(spark, folder), ["user_id"], F.col("v"), F.col("v"), threshold=10.0)
    return out.select("user_id", *[(F.col(c) if c == "spo2_min" else r(F.col(c))).alias(c) for c in out.columns[1:]])


@query("sparse_quota", f"""WITH RECURSIVE {_SPARSE},
s AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM sp WHERE ts IS NOT NULL),
q AS (SELECT user_id, i, event_id, [t] AS h, true AS allowed, {LIMIT - 1} AS remaining FROM s WHERE i = 1
  UNION ALL
  SELECT user_id, i, event_id, CASE WHEN len(hh) >= {LIMIT} THEN hh ELSE list_append(hh, t) END, len(hh) < {LIMIT},
         CASE WHEN len(hh) >= {LIMIT} THEN 0 ELSE {LIMIT} - len(hh) - 1 END
  FROM (SELECT s.*, list_filter(q.h, lambda x: x > s.t - {HORIZON * 1_000_000}) AS hh FROM q JOIN s ON s.user_id IS NOT DISTINCT FROM q.user_id AND s.i = q.i + 1)),
n AS (SELECT event_id, count(*) OVER w AS requested FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {HORIZON * 1_000_000 - 1} PRECEDING AND CURRENT ROW))
SELECT sp.event_id, sp.user_id, requested, requested > {LIMIT} AS over_limit, allowed, remaining::BIGINT AS remaining
FROM sp LEFT JOIN q USING (event_id) LEFT JOIN n USING (event_id)""")
def sparse_quota(spark, folder):
    df = sparse(spark, folder).select("event_id", "ts", "user_id")
    counted = sessions.requested_rate(df, "user_id", "ts", HORIZON, LIMIT).select("event_id", "requested", "over_limit")
    made = sessions.admitted(df, "user_id", ORDER, HORIZON, LIMIT).select("event_id", "user_id", "allowed", "remaining")
    return made.join(counted, "event_id").select("event_id", "user_id", "requested", "over_limit", "allowed", "remaining")


@query("sparse_metrics", """
WITH s AS (SELECT CASE WHEN d.doc_id % 5 <> 0 THEN lang END AS grp, l.quality AS y, CASE WHEN d.doc_id % 7 <> 0 THEN (d.n_chars % 1000) / 1000.0::DOUBLE END AS p
           FROM labels l JOIN documents d USING (doc_id)),
k AS (SELECT grp, y, p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS yhat FROM s WHERE p IS NOT NULL)
SELECT grp, count(*) AS n, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
  count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 1 AND yhat = 0) AS fn FROM k GROUP BY grp""")
def sparse_metrics(spark, folder):
    """A NULL group is a group; documents without a score take no part."""
    docs = table(spark, folder, "documents", "doc_id", "lang", "n_chars")
    p = F.when(F.col("doc_id") % 7 != 0, (F.col("n_chars") % 1000) / 1000.0)
    rows = table(spark, folder, "labels", "doc_id", "quality").join(docs, "doc_id").select(
        F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("grp"), F.col("quality").alias("y"), p.alias("p"), F.when(p > 0.5, 1).otherwise(0).alias("yhat"))
    return metrics.clinical_metrics(rows, ["grp"], "y", "yhat", "p").select("grp", "n", "tp", "fp", "tn", "fn")


@query("array_slices", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda a: a::DOUBLE) AS x FROM embeddings),
w AS (SELECT vec_id, x, x[1:25] AS y, unnest(range(0, 7)) AS w FROM x),
s AS (SELECT *, y[least(24, w * 8 * 25 // 64) + 1:least(25, (w * 8 + 16) * 25 // 64)] AS z FROM w)
SELECT vec_id, w::INT AS w_idx, (w * 8)::INT AS start, (w * 8 + 16)::INT AS "end", round(list_max(x[w * 8 + 1:w * 8 + 16]), 6) AS top, len(z)::INT AS n_second, round(list_max(z), 6) AS top_second FROM s""")
def array_slices(spark, folder):
    """Windows of a whole recording held as an array, each with its part of a slower channel (25 samples to 64)."""
    cut = embeddings(spark, folder).select("vec_id", F.slice("x", 1, 25).alias("y"), F.size("x").alias("n"), F.inline(arrays.windows(F.col("x"), 16, 8)))
    second = arrays.proportional_slice(F.col("y"), F.col("start"), F.col("end"), F.col("n"))
    return cut.select("vec_id", "w_idx", "start", "end", r(F.array_max("samples")).alias("top"), F.size(second).alias("n_second"), r(F.array_max(second)).alias("top_second"))


@query("age_cohorts", """
SELECT c_custkey, CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age >= 65 THEN 'Senior (>=65)' ELSE 'Non-Senior (<65)' END AS cohort
FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 90 END AS age FROM customer)""")
def age_cohorts(spark, folder):
    age = F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 90)
    return table(spark, folder, "customer", "c_custkey").select("c_custkey", triage.age_cohort(age).alias("cohort"))


@query("persisted_features", """
SELECT vec_id, label, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS mean, 'test' AS split FROM embeddings WHERE vec_id % 3 = 2""")
def persisted_features(spark, folder):
    """Features stored by split; reading one split opens only its files."""
    path = scratch(spark, "features")
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("vec_id") % 3 + 1).cast("int"))
    x = F.col("embedding").cast("array<double>")
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    sinks.write_features(table(spark, folder, "embeddings").select("vec_id", "label", r(mean).alias("mean"), split.alias("split")), path)
    return spark.read.parquet(path).where("split = 'test'").select("vec_id", "label", "mean", "split")


@query("stream_windows", """
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS n
FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS b) x
GROUP BY 1, 2""")
def stream_windows(spark, folder):
    counts = device.window_counts(device.table_stream(spark, folder, "events"), "ts", ["event_type"], "10 minutes", "5 minutes", "365 days")
    out = device.drain_updates(counts, lambda u: u.groupBy("window_start", "event_type").agg(F.max_by("n", "batch_id").alias("n")))
    return out.select(stamp(F.col("window_start")).alias("window_start"), "event_type", "n")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
c AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY user_id, session)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS session_end, n
FROM c WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, folder):
    """Sessions that the watermark (one hour late) has closed."""
    df = device.wear_sessions(device.table_stream(spark, folder, "events"), "ts", "user_id", "30 minutes", "1 hour")
    return device.drain(df).select("user_id", stamp(F.col("session_start")).alias("session_start"), stamp(F.col("session_end")).alias("session_end"), "n")


@query("manifest_check", """
WITH f(file, status) AS (VALUES ('events.parquet', 'OK'), ('orders.parquet', 'MISMATCH'), ('region.parquet', 'OK'), ('no-such-file.parquet', 'MISSING'))
SELECT file, status FROM f""")
def manifest_check(spark, folder):
    """Digests of the table's files against a list: one agrees in capitals, one is wrong, one is unknown, one has no file."""
    actual = manifest.manifest(spark, folder, "*.parquet")
    listed = actual.where(F.col("file").isin("events.parquet", "orders.parquet", "region.parquet")).select(
        "file", F.when(F.col("file") == "events.parquet", F.upper("sha256")).when(F.col("file") == "orders.parquet", F.lit("0" * 64)).alias("expected_sha256"))
    expected = listed.union(spark.createDataFrame([("no-such-file.parquet", "0" * 64)], listed.schema))
    return manifest.verify(actual, expected, folder).select("file", "status")
