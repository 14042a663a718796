"""Training, scoring and reporting queries over the device windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.operators import ecg, fairness, metrics, model, splits
from pulseframe.plans.evaluation import _ALL, _fair_sql
from pulseframe.plans.registry import query, with_
from pulseframe.plans.roles import r, scored
from pulseframe.plans.waveforms import _RAW_SQL, _RECORDS, record_windows
from pulseframe.session import scratch
from pulseframe.sources.sinks import materialise, report, write_report

FEATURES = C.FEATURES
# Boosting cannot be replayed in SQL. cv_folds, train_calibrated and score_consistency return what
# SQL can state of it; cv_metrics, tune, cv_predictions, validation_metrics and score_batch return
# the values themselves and have no SQL: the tests recompute them from the predictions.
_LABELS = _RECORDS + ",\n" + _RAW_SQL + """,
lab AS (SELECT record_id AS patient, w_idx, (spo2_mean > 93.002)::INT AS y FROM raw),
pt AS (SELECT patient, count(*) AS n_rows, sum(y)::BIGINT AS n_pos, least(floor(10 * sum(y) / count(*)::DOUBLE), 9)::INT AS stratum FROM lab GROUP BY 1)"""
_LABEL_SPLIT = _LABELS + """,
tst AS (SELECT *, (row_number() OVER (ORDER BY stratum, md5('42-test:' || patient)) - 1) % 5 AS f FROM pt),
vld AS (SELECT *, (row_number() OVER (ORDER BY stratum, md5('42-val:' || patient)) - 1) % 5 AS v FROM tst WHERE f <> 0),
split AS (SELECT patient, 'test' AS split FROM tst WHERE f = 0 UNION ALL SELECT patient, CASE WHEN v = 0 THEN 'val' ELSE 'train' END FROM vld)"""


def labelled_windows(spark, folder) -> DataFrame:
    """The 26 features of every record window; the label is a raised mean saturation."""
    w = ecg.window_features(record_windows(spark, folder), "ecg", "fs", "ppg", "spo2", gate=False)
    finite = [F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)).alias(c) for c in FEATURES]
    return materialise(w.select(F.col("record_id").alias("patient"), "w_idx", *finite, (F.col("spo2_mean") > 93.002).cast("int").alias("y")), "labelled")


def split_windows(spark, folder) -> DataFrame:
    df = labelled_windows(spark, folder)
    return materialise(splits.attach(df, splits.split_patients(df, "patient", "y"), "patient", "split"), "windows")


@query("cv_folds", with_(_LABELS) + """,
f AS (SELECT *, (row_number() OVER (ORDER BY stratum, md5('42:' || patient)) - 1) % 5 AS fold FROM pt)
SELECT fold::INT AS fold, sum(n_rows)::BIGINT AS n, sum(n_pos)::BIGINT AS n_pos FROM f GROUP BY fold""")
def cv_folds(spark, folder):
    """Rows and positives of the folds that cross-validation uses."""
    df = labelled_windows(spark, folder)
    rows = splits.attach(df, splits.folds(df, "patient", "y", C.N_FOLDS, C.SEED), "patient", "fold")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


def _predictions(spark, folder) -> DataFrame:
    return model.out_of_fold(labelled_windows(spark, folder), FEATURES, "y", "patient", [C.CV_PARAMS], keep=["w_idx"])


@query("cv_predictions")
def cv_predictions(spark, folder):
    """Every window with the probability given by trees that have not seen its patient."""
    return _predictions(spark, folder).select("fold", "patient", "w_idx", "y", "p", "yhat")


@query("cv_metrics")
def cv_metrics(spark, folder):
    out = model.cross_validate(labelled_windows(spark, folder), FEATURES, "y", "patient")
    rates = ["auc_roc", "pr_auc", "sensitivity", "specificity", "f1_score", "brier_score"]
    return out.select("fold", "n", (F.col("tp") + F.col("fn")).alias("n_pos"), *rates)


@query("tune")
def tune(spark, folder):
    """The search grid by mean AUC over patient-grouped folds, best first."""
    found = model.tune(labelled_windows(spark, folder), FEATURES, "y", "patient")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_auc"), "candidate")))  # one row a candidate


def _trained(spark, folder):
    data = split_windows(spark, folder)
    return data, model.train(data.where("split = 'train'"), FEATURES, "y", "patient")


@query("train_calibrated", with_(_LABEL_SPLIT) + """
SELECT split, count(*) AS n, sum(y)::BIGINT AS n_pos, true AS same_after_reload, true AS in_range FROM lab JOIN split USING (patient) WHERE split = 'val' GROUP BY split""")
def train_calibrated(spark, folder):
    """Validation rows of the calibrated ensemble: answers before and after a save and a load agree."""
    data, fitted = _trained(spark, folder)
    path = scratch(spark, "model")
    fitted.save(spark, path)
    val = data.where("split = 'val'")
    answers = [m.score(val).select("patient", "w_idx", "split", "y", F.col("pathology_probability").alias(n)) for m, n in ((fitted, "a"), (model.RiskModel.load(spark, path), "b"))]
    both = answers[0].join(answers[1].select("patient", "w_idx", "b"), ["patient", "w_idx"])
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.every(F.col("a") == F.col("b")).alias("same_after_reload"), F.every(F.col("a").between(0, 1)).alias("in_range"))


@query("validation_metrics")
def validation_metrics(spark, folder):
    """AUC, sensitivity and the rest of the final fit, per split."""
    data, fitted = _trained(spark, folder)
    out = metrics.clinical_metrics(fitted.score(data), ["split"], "y", "predicted_class", "pathology_probability")
    return out.select("split", "n", "auc_roc", "pr_auc", "sensitivity", "specificity", "f1_score", "brier_score")


@query("score_batch")
def score_batch(spark, folder):
    """Every row with its probability, class, confidence and tier."""
    data, fitted = _trained(spark, folder)
    return fitted.score(data).select("patient", "w_idx", "split", "y", "pathology_probability", "predicted_class", "confidence", "class_label", "risk_tier")


@query("score_consistency", with_(_LABEL_SPLIT) + """
SELECT split, count(*) AS n, sum(y)::BIGINT AS n_pos, 0::BIGINT AS inconsistent FROM lab JOIN split USING (patient) GROUP BY split""")
def score_consistency(spark, folder):
    """Rows of each split, and how many answers do not follow from their probability."""
    data, fitted = _trained(spark, folder)
    p = F.col("pathology_probability")
    label = F.when(F.col("predicted_class") == 1, C.CLASS_LABELS[1]).otherwise(C.CLASS_LABELS[0])
    tier = F.when(p >= 0.70, "CRITICAL").when(p >= 0.35, "MONITOR").otherwise("LOW_RISK")
    fits = p.between(0, 1) & ((p > 0.5) == (F.col("predicted_class") == 1)) & (F.col("class_label") == label) & (F.col("risk_tier") == tier) & (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) < 1e-12)
    return fitted.score(data).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("inconsistent"))


_REPORT = """report_metadata array<struct<title string, scored_rows bigint>>, clinical_metrics array<struct<auc_roc double, brier_score double, tp bigint>>,
 fairness_audit array<struct<attribute string, disparate_impact double>>, fairness_groups array<struct<grp string, sample_count bigint>>"""


@query("eval_report", _ALL.rstrip() + ",\n" + _fair_sql("lang", "source").split("FROM labels l JOIN documents d USING (doc_id)),\n")[1] + """
SELECT 'Evaluation report' AS title, any_value(n) AS scored_rows, round(any_value(auc_roc), 6) AS auc_roc, round(any_value(brier_score), 6) AS brier_score, any_value(tp) AS tp,
  (SELECT count(*) FROM au)::INT AS n_attributes, (SELECT round_even(min(di), 4) FROM au) AS lowest_impact, (SELECT sum(sample_count) FROM g)::BIGINT AS group_rows FROM met""")
def eval_report(spark, folder):
    """Metrics and fairness audit as one JSON document, written and read back."""
    df = scored(spark, folder).withColumn("cohort", F.lit("all"))
    rates = fairness.subgroup_rates(df, {"lang": "lang", "source": "source"}, "y", "yhat")
    doc = report({
        "report_metadata": df.groupBy().agg(F.count(F.lit(1)).alias("scored_rows")).select(
            F.lit("Evaluation report").alias("title"), F.lit("de-identified").alias("privacy"), "scored_rows"),
        "clinical_metrics": metrics.clinical_metrics(df, ["cohort"], "y", "yhat", "p"),
        "fairness_audit": fairness.audit(rates), "fairness_groups": fairness.subgroup_report(rates),
    })
    path = scratch(spark, "report")
    write_report(doc, path)
    back = spark.read.schema(_REPORT).json(path)
    m, audit, groups = F.col("clinical_metrics")[0], F.col("fairness_audit"), F.col("fairness_groups")
    return back.select(
        F.col("report_metadata")[0]["title"].alias("title"), F.col("report_metadata")[0]["scored_rows"].alias("scored_rows"),
        r(m["auc_roc"]).alias("auc_roc"), r(m["brier_score"]).alias("brier_score"), m["tp"].alias("tp"),
        F.size(audit).alias("n_attributes"), F.array_min(audit["disparate_impact"]).alias("lowest_impact"),
        F.aggregate(groups["sample_count"], F.lit(0).cast("long"), lambda a, v: a + v).alias("group_rows"))
