"""Splits, metrics and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.operators import fairness, metrics, splits
from pulseframe.plans.registry import SCORED, query, with_
from pulseframe.plans.roles import events, r, scored
from pulseframe.sources.tables import table


def labelled_events(spark, folder):
    return events(spark, folder, "event_id", "user_id", "event_type").select(
        "event_id", "user_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"))


_PATIENTS = """pt AS (SELECT user_id, count(*) AS n_rows, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS n_pos,
    least(floor(10 * sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*)::DOUBLE), 9)::INT AS stratum FROM events GROUP BY 1)"""
_SPLIT = _PATIENTS + """,
t AS (SELECT *, (row_number() OVER (ORDER BY stratum, md5('42-test:' || user_id)) - 1) % 5 AS t FROM pt),
v AS (SELECT *, (row_number() OVER (ORDER BY stratum, md5('42-val:' || user_id)) - 1) % 5 AS v FROM t WHERE t <> 0),
split AS (SELECT user_id, n_rows, n_pos, stratum, 'test' AS split FROM t WHERE t = 0 UNION ALL
          SELECT user_id, n_rows, n_pos, stratum, CASE WHEN v = 0 THEN 'val' ELSE 'train' END FROM v)"""


@query("patient_split", with_(_SPLIT) + "SELECT * FROM split")
def patient_split(spark, folder):
    return splits.split_patients(labelled_events(spark, folder), "user_id", "y")


@query("patient_folds", with_(_PATIENTS) + """
SELECT *, ((row_number() OVER (ORDER BY stratum, md5('42:' || user_id)) - 1) % 5)::INT AS fold FROM pt""")
def patient_folds(spark, folder):
    return splits.folds(labelled_events(spark, folder), "user_id", "y")


@query("leakage_check", with_(_SPLIT) + """,
r AS (SELECT 'patient' AS scheme, e.user_id, s.split FROM events e JOIN split s USING (user_id)
      UNION ALL SELECT 'row', user_id, CASE event_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END FROM events),
p AS (SELECT scheme, user_id, max((split = 'train')::INT) AS a, max((split = 'val')::INT) AS b, max((split = 'test')::INT) AS c FROM r GROUP BY 1, 2)
SELECT scheme, sum(a)::BIGINT AS train_patients, sum(b)::BIGINT AS val_patients, sum(c)::BIGINT AS test_patients,
  sum(a * b)::BIGINT AS train_val_overlap, sum(a * c)::BIGINT AS train_test_overlap, sum(b * c)::BIGINT AS val_test_overlap FROM p GROUP BY 1""")
def leakage_check(spark, folder):
    """The patient split next to a row-wise split, which must leak."""
    df = labelled_events(spark, folder)
    isolated = splits.attach(df, splits.split_patients(df, "user_id", "y"), "user_id", "split")
    k = F.col("event_id") % 3
    leaky = F.when(k == 0, "train").when(k == 1, "val").otherwise("test")
    schemes = F.array(F.struct(F.lit("patient").alias("scheme"), F.col("split")), F.struct(F.lit("row").alias("scheme"), leaky.alias("split")))
    return splits.leakage(isolated.select("user_id", F.inline(schemes)), "user_id", by=["scheme"])


@query("class_weights", """
WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)
SELECT quality, n, round(sum(n) OVER () / (count(*) OVER () * n::DOUBLE), 6) AS weight FROM c""")
def class_weights(spark, folder):
    return splits.class_weights(table(spark, folder, "labels", "quality"), "quality").withColumn("weight", r(F.col("weight")))


@query("class_balance", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def class_balance(spark, folder):
    return splits.class_balance(table(spark, folder, "labels", "quality"), "quality")


def metrics_sql(source: str, keys: str, empty_specificity: str = "0.0") -> str:
    """Metric views per ``keys`` over a source with y, yhat, p."""
    return f"""
cnt AS (SELECT {keys}, count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
   count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) AS n,
   avg(pow(p - y, 2)) AS brier_score, avg(y) AS prevalence FROM {source} GROUP BY {keys}),
thr AS (SELECT {keys}, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY {keys}, p),
cum AS (SELECT *, sum(pos) OVER d AS ctp, sum(neg) OVER d AS cfp, sum(pos) OVER k AS np, sum(neg) OVER k AS nn FROM thr
        WINDOW d AS (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY {keys})),
pt AS (SELECT *, CASE WHEN np > 0 THEN ctp / np::DOUBLE ELSE 0.0 END AS rec, ctp / (ctp + cfp)::DOUBLE AS prec, CASE WHEN nn > 0 THEN cfp / nn::DOUBLE ELSE 0.0 END AS fpr FROM cum),
st AS (SELECT *, lag(rec, 1, 0.0) OVER d AS rec0, lag(prec, 1, 1.0) OVER d AS prec0, lag(fpr, 1, 0.0) OVER d AS fpr0 FROM pt
       WINDOW d AS (PARTITION BY {keys} ORDER BY p DESC)),
area AS (SELECT {keys}, CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum((fpr - fpr0) * (rec + rec0) / 2) ELSE 0.5 END AS auc_roc,
   CASE WHEN max(np) > 0 AND max(nn) > 0 THEN sum((rec - rec0) * (prec + prec0) / 2) ELSE 0.0 END AS pr_auc FROM st GROUP BY {keys}),
met AS (SELECT cnt.*, auc_roc, pr_auc,
   CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS sensitivity,
   CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE {empty_specificity} END AS specificity,
   CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn)::DOUBLE ELSE 0.0 END AS npv,
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0.0 END AS f1_score
 FROM cnt JOIN area USING ({keys}))"""


_RATES = ["sensitivity", "specificity", "ppv", "npv", "f1_score", "auc_roc", "pr_auc", "brier_score", "prevalence"]
_BY_LANG = with_(SCORED, metrics_sql("scored", "lang").strip())
_ALL = with_(SCORED, "everyone AS (SELECT *, 'all' AS cohort FROM scored)", metrics_sql("everyone", "cohort").strip())


def _everyone(spark, folder):
    return scored(spark, folder).withColumn("cohort", F.lit("all"))


@query("clinical_metrics", _ALL + "SELECT cohort, tp, fp, tn, fn, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)
       + ", " + ", ".join(f"round({c} / n::DOUBLE * 100, 6) AS {c}_pct" for c in ("tp", "fp", "tn", "fn")) + " FROM met")
def clinical_metrics(spark, folder):
    m = metrics.clinical_metrics(_everyone(spark, folder), ["cohort"], "y", "yhat", "p")
    counts = ["cohort", "tp", "fp", "tn", "fn", "n"]
    return m.select(*counts, *[r(F.col(c)).alias(c) for c in m.columns if c not in counts])


@query("clinical_metrics_by_group", _BY_LANG + "SELECT lang, tp, fp, tn, fn, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _RATES) + " FROM met")
def clinical_metrics_by_group(spark, folder):
    m = metrics.clinical_metrics(scored(spark, folder), ["lang"], "y", "yhat", "p")
    return m.select("lang", "tp", "fp", "tn", "fn", "n", *[r(F.col(c)).alias(c) for c in _RATES])


@query("roc_auc", _ALL + "SELECT cohort, round(auc_roc, 6) AS auc_roc FROM met")
def roc_auc(spark, folder):
    return metrics.roc_auc(_everyone(spark, folder), ["cohort"], "y", "p").select("cohort", r(F.col("auc_roc")).alias("auc_roc"))


@query("pr_auc", _ALL + "SELECT cohort, round(pr_auc, 6) AS pr_auc FROM met")
def pr_auc(spark, folder):
    return metrics.pr_auc(_everyone(spark, folder), ["cohort"], "y", "p").select("cohort", r(F.col("pr_auc")).alias("pr_auc"))


@query("roc_points", _BY_LANG + "SELECT lang, p AS threshold, round(fpr, 6) AS fpr, round(rec, 6) AS tpr, round(prec, 6) AS precision FROM pt")
def roc_points(spark, folder):
    return metrics.curve_points(scored(spark, folder), ["lang"], "y", "p").select(
        "lang", "threshold", *[r(F.col(c)).alias(c) for c in ("fpr", "tpr", "precision")])


@query("calibration_bins", with_(SCORED) + """
SELECT lang, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM scored GROUP BY 1, 2""")
def calibration_bins(spark, folder):
    return metrics.calibration_bins(scored(spark, folder), ["lang"], "y", "p").select(
        "lang", "bin", "n", r(F.col("mean_p")).alias("mean_p"), r(F.col("observed")).alias("observed"))


def _fair_sql(*attributes: str) -> str:
    return SCORED + """,
a AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a} AS grp, y, yhat FROM scored" for a in attributes) + """),
g AS (SELECT attribute, grp, count(*) AS sample_count, avg(yhat) AS sel, coalesce(avg(yhat) FILTER (y = 1), 0.0) AS tpr, coalesce(avg(yhat) FILTER (y = 0), 0.0) AS fpr
      FROM a GROUP BY 1, 2),
au AS (SELECT attribute, CASE WHEN max(sel) > 1e-6 THEN min(sel) / max(sel) ELSE 1.0 END AS di, max(tpr) - min(tpr) AS td, max(fpr) - min(fpr) AS fd FROM g GROUP BY 1)"""


_GROUP_OUT = """SELECT attribute, grp, sample_count, round_even(sel, 4) AS selection_rate, round_even(tpr, 4) AS true_positive_rate,
  round_even(fpr, 4) AS false_positive_rate, round_even(1 - fpr, 4) AS specificity FROM g"""
_AUDIT_OUT = """SELECT attribute, round_even(di, 4) AS disparate_impact, round_even(td, 4) AS tpr_disparity, round_even(fd, 4) AS fpr_disparity,
  di >= 0.80 AND td <= 0.15 AS is_fair_80_percent_rule FROM au"""


@query("fairness_groups", "WITH " + _fair_sql("lang") + "\n" + _GROUP_OUT)
def fairness_groups(spark, folder):
    rates = fairness.subgroup_rates(scored(spark, folder), {"lang": "lang"}, "y", "yhat")
    return fairness.subgroup_report(rates).drop("tpr_defined")


@query("fairness_audit", "WITH " + _fair_sql("lang") + "\n" + _AUDIT_OUT)
def fairness_audit(spark, folder):
    rates = fairness.subgroup_rates(scored(spark, folder), {"lang": "lang"}, "y", "yhat")
    return fairness.audit(rates).drop("all_tpr_defined")


@query("fairness_multi", "WITH " + _fair_sql("lang", "source") + "\n" + _AUDIT_OUT)
def fairness_multi(spark, folder):
    rates = fairness.subgroup_rates(scored(spark, folder), {"lang": "lang", "source": "source"}, "y", "yhat")
    return fairness.audit(rates).drop("all_tpr_defined")


@query("cv_summary", with_(SCORED, "f AS (SELECT *, doc_id % 5 AS fold FROM scored)", metrics_sql("f", "fold", "1.0").strip()) + """
SELECT count(*) AS n_folds, round(avg(auc_roc), 6) AS mean_auc_roc, round(avg(sensitivity), 6) AS mean_sensitivity, round(avg(specificity), 6) AS mean_specificity,
  round(avg(f1_score), 6) AS mean_f1_score, round(stddev_pop(auc_roc), 6) AS std_auc_roc, round(stddev_pop(sensitivity), 6) AS std_sensitivity,
  round(stddev_pop(specificity), 6) AS std_specificity, round(stddev_pop(f1_score), 6) AS std_f1_score FROM met""")
def cv_summary(spark, folder):
    df = scored(spark, folder).withColumn("fold", F.col("doc_id") % 5)
    per_fold = metrics.clinical_metrics(df, ["fold"], "y", "yhat", "p", empty_specificity=1.0)
    out = metrics.fold_summary(per_fold, ["auc_roc", "sensitivity", "specificity", "f1_score"])
    return out.select("n_folds", *[r(F.col(c)).alias(c) for c in out.columns[1:]])
