"""Boosted trees with patient-grouped validation, search and sigmoid calibration."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import TypeVar

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import triage
from pulseframe.operators import metrics, splits
from pulseframe.sources.sinks import materialise

T = TypeVar("T")
_TEMP = ["features", "_g_raw", "_g_prob", "_g_pred", "_margin", "_c_raw", "_c_prob", "_c_pred"]


def _trees(features: list[str], label: str, params: dict, seed: int) -> Pipeline:
    trees = GBTClassifier(labelCol=label, weightCol="weight", featuresCol="features", predictionCol="_g_pred", seed=seed, **params)
    trees = trees.setRawPredictionCol("_g_raw").setProbabilityCol("_g_prob")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), trees])


FITS_AT_ONCE = 4


def _together(fits: list[Callable[[], T]]) -> list[T]:
    """Independent fits, a few at a time: each is a long chain of small jobs that leaves most cores idle."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda fit: fit(), fits))


def _probability(model: PipelineModel, df: DataFrame, column: str, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array(column)[1])
    return scored.drop(*_TEMP)


def cross_validate(
    df: DataFrame, features: list[str], label: str, patient: str, k: int = C.N_FOLDS, params: dict = C.CV_PARAMS,
    seed: int = C.SEED, weight_power: int = 1,
) -> DataFrame:
    """Metrics per patient-grouped fold: fit on the other folds, score the held-out patients.

    ``weight_power=2`` weights classes twice, as balanced trees fed balanced weights do.
    """
    scored = out_of_fold(df, features, label, patient, [params], k, seed, weight_power)
    return metrics.clinical_metrics(scored, ["fold"], label, "yhat", "p", empty_specificity=1.0)


def out_of_fold(
    df: DataFrame, features: list[str], label: str, patient: str, grid: list[dict], k: int = C.N_FOLDS, seed: int = C.SEED,
    weight_power: int = 1, keep: list[str] | None = None,
) -> DataFrame:
    """One long table (candidate, fold, patient, keep, label, p, yhat): every row's probability by trees that have not seen its patient.

    All fits, of all candidates and folds, share one pool. The table is written once, so
    metrics, rankings and reports read the same predictions.
    """
    assigned = splits.folds(df, patient, label, k, seed)
    rows = [patient, *(keep or []), label]
    data = materialise(splits.attach(df.select(*dict.fromkeys([*rows, *features])), assigned, patient, "fold"), "folds")

    def fit(candidate: int, i: int) -> DataFrame:
        train = splits.with_weights(data.where(F.col("fold") != i), label, power=weight_power)
        model = _trees(features, label, grid[candidate], seed + i).fit(train)
        held = _probability(model, data.where(F.col("fold") == i), "_g_prob", "p")
        return held.select(F.lit(candidate).alias("candidate"), "fold", *rows, "p")

    parts = _together([partial(fit, c, i) for c in range(len(grid)) for i in range(k)])
    scored = reduce(DataFrame.unionByName, parts)
    return materialise(scored.withColumn("yhat", triage.predicted_class(F.col("p"))), "out-of-fold")


def tune(
    df: DataFrame, features: list[str], label: str, patient: str, grid: list[dict] = C.SEARCH_GRID, k: int = 3,
    seed: int = C.SEED, weight_power: int = 1,
) -> DataFrame:
    """Mean AUC per candidate, best first; equal candidates keep their order."""
    scored = out_of_fold(df, features, label, patient, grid, k, seed, weight_power)
    return ranking(metrics.roc_auc(scored, ["candidate", "fold"], label, "p"), grid)


def ranking(per_fold: DataFrame, grid: list[dict]) -> DataFrame:
    """(candidate, params, mean_auc), best first, from (candidate, fold, auc_roc)."""
    names = F.create_map(*[x for i, g in enumerate(grid) for x in (F.lit(i), F.lit(json.dumps(g, sort_keys=True)))])
    table = per_fold.groupBy("candidate").agg(F.avg("auc_roc").alias("mean_auc"))
    return table.select("candidate", names[F.col("candidate")].alias("params"), "mean_auc").orderBy(F.desc("mean_auc"), "candidate")


def best_params(search: DataFrame) -> dict:
    return json.loads(search.first()["params"])


@dataclass
class RiskModel:
    """Calibrated ensemble: the mean of the parts' probabilities."""

    features: list[str]
    parts: list[PipelineModel]
    calibrated: bool
    labels: dict[int, str] = field(default_factory=lambda: dict(C.CLASS_LABELS))

    def score(self, df: DataFrame) -> DataFrame:
        """Add pathology_probability, predicted_class, confidence, class_label, risk_tier."""
        column = "_c_prob" if self.calibrated else "_g_prob"
        names = [f"_p{i}" for i in range(len(self.parts))]
        for name, part in zip(names, self.parts):
            df = _probability(part, df, column, name)
        total = F.col(names[0])
        for name in names[1:]:
            total = total + F.col(name)
        p = F.col("pathology_probability")
        return df.withColumn("pathology_probability", total / len(names)).drop(*names).withColumns({
            "predicted_class": triage.predicted_class(p), "confidence": triage.confidence(p),
            "class_label": triage.class_label(triage.predicted_class(p), self.labels), "risk_tier": triage.risk_tier(p),
        })

    def save(self, spark: SparkSession, path: str) -> None:
        for i, part in enumerate(self.parts):
            part.write().overwrite().save(f"{path}/part-{i}")
        meta = {"features": self.features, "parts": len(self.parts), "calibrated": self.calibrated, "labels": self.labels}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RiskModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        parts = [PipelineModel.load(f"{path}/part-{i}") for i in range(meta["parts"])]
        return cls(meta["features"], parts, meta["calibrated"], {int(k): v for k, v in meta["labels"].items()})


def train(
    df: DataFrame, features: list[str], label: str, patient: str, params: dict = C.FINAL_PARAMS, seed: int = C.SEED,
    k: int = C.CALIBRATION_FOLDS, weight_power: int = 1, calibrate: bool | None = None,
) -> RiskModel:
    """Trees per patient-grouped fold, each with a sigmoid fitted on its held-out margins.

    The sigmoid's targets are the smoothed class frequencies, so every held-out row enters
    twice, as a positive and a negative of matching weight. ``calibrate=False`` fits plain trees
    on all rows; by default (None) that happens below 50 rows, too few to hold any out.
    """
    weighted = splits.with_weights(df.select(patient, label, *features), label, power=weight_power)
    assigned = splits.folds(df, patient, label, k, seed)
    data = materialise(splits.attach(weighted, assigned, patient, "fold"), "train")
    if calibrate is False or (calibrate is None and data.count() < C.CALIBRATION_MIN_ROWS):
        return RiskModel(features, [_trees(features, label, params, seed).fit(data)], calibrated=False)
    def part(i: int) -> PipelineModel:
        trees = _trees(features, label, params, seed).fit(data.where(F.col("fold") != i))
        slicer = VectorSlicer(inputCol="_g_raw", outputCol="_margin", indices=[1])
        held = slicer.transform(trees.transform(data.where(F.col("fold") == i)))
        sums = held.agg(
            F.sum(F.when(F.col(label) == 1, F.col("weight")).otherwise(0.0)).alias("pos"),
            F.sum(F.when(F.col(label) == 0, F.col("weight")).otherwise(0.0)).alias("neg")).first()
        target = F.when(F.col(label) == 1, (sums["pos"] + 1.0) / (sums["pos"] + 2.0)).otherwise(1.0 / (sums["neg"] + 2.0))
        sides = F.array(F.struct(F.lit(1.0).alias("_y"), target.alias("_t")), F.struct(F.lit(0.0).alias("_y"), (1.0 - target).alias("_t")))
        doubled = held.select("_margin", "weight", F.inline(sides)).select("_margin", "_y", (F.col("weight") * F.col("_t")).alias("_w"))
        sigmoid = LogisticRegression(
            featuresCol="_margin", labelCol="_y", weightCol="_w", rawPredictionCol="_c_raw", probabilityCol="_c_prob",
            predictionCol="_c_pred", regParam=0.0, standardization=False, maxIter=100).fit(doubled)
        return PipelineModel(stages=[*trees.stages, slicer, sigmoid])

    parts = _together([partial(part, i) for i in range(k)])
    return RiskModel(features, parts, calibrated=True)
