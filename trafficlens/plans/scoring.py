"""Whole jobs: fit or load the models, score sessions, decide, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, Settings
from trafficlens.operators import boosting, evaluation, models
from trafficlens.operators.detectors import (score_without_models, with_agent_score, with_ensemble,
                                             with_rules)
from trafficlens.operators.features import session_features
from trafficlens.operators.mitigation import decide_in_context
from trafficlens.operators.skew import materialize
from trafficlens.plans import store


@dataclass(frozen=True)
class Detectors:
    forest: models.ForestModel
    boosting: boosting.BoostedModel

    def save(self, spark: SparkSession, path: str) -> str:
        """Write a new version under the path; readers see it once it is whole. Returns its name."""
        def write(folder: str) -> None:
            models.save_forest(spark, self.forest, f"{folder}/forest")
            boosting.save(spark, self.boosting, f"{folder}/boosting")
        return store.save(spark, path, write)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Detectors:
        """The newest whole version, or the one named."""
        folder = store.folder(spark, path, version)
        return cls(models.load_forest(spark, f"{folder}/forest"), boosting.load(spark, f"{folder}/boosting"))


def fit_detectors(train: DataFrame, config: Settings = DEFAULT) -> Detectors:
    return Detectors(models.fit_forest(train, config), models.fit_boosting(train, config))


def saved_at(spark: SparkSession, path: str) -> bool:
    """Whether a whole version of the models is under the path, on whatever file system it is."""
    return bool(store.versions(spark, path))


def load_or_fit(features: DataFrame, path: str, config: Settings = DEFAULT) -> tuple[Detectors, DataFrame]:
    """Saved detectors and all sessions; or detectors fitted on the first 60 % and the rest."""
    spark = features.sparkSession
    if saved_at(spark, path):
        return Detectors.load(spark, path), features
    train, rest = models.first_part(features, 0.6, [F.col("start_ms"), F.col("session_id")])
    return fit_detectors(train, config), rest


def score(features: DataFrame, detectors: Detectors | None = None,
          config: Settings = DEFAULT) -> DataFrame:
    """All layers and the risk score; the model layers count as 0 without detectors."""
    if detectors is None:
        return score_without_models(features, config)
    with_models = models.with_boosting(models.with_forest(features, detectors.forest), detectors.boosting)
    return with_ensemble(with_agent_score(with_rules(with_models, config), config), config)


def decide_requests(requests: DataFrame, detectors: Detectors | None = None,
                    config: Settings = DEFAULT) -> DataFrame:
    """Requests to one decision per session."""
    return decide_in_context(score(session_features(requests, config), detectors, config), config)


def eval_input(scored: DataFrame, score_column: str = "risk_score") -> DataFrame:
    return scored.select("session_id", "traffic_class", F.col("label").alias("y_true"),
                         F.col(score_column).alias("y_score"))


def train_and_evaluate(requests: DataFrame, path: str, config: Settings = DEFAULT,
                       target_fpr: float = 0.01) -> DataFrame:
    """Split, fit, save, score the held-out sessions, write and return the report row."""
    spark = requests.sparkSession
    train, test = models.train_test_split(session_features(requests, config), 0.2, config.models.seed)
    detectors = fit_detectors(train, config)
    detectors.save(spark, path)
    watched, watch = evaluation.observed(eval_input(score(test, detectors, config)))
    judged = materialize(watched, "judged")
    # the counts come from that write; only the areas and the classes read the scores again
    grid = evaluation.observed_grid(spark, watch)
    best = evaluation.best_of_grid(grid.filter(F.col("threshold").isin(*evaluation.THRESHOLDS)), target_fpr).first()["threshold"]
    report = evaluation.full_report(judged, best, grid.filter(F.col("threshold") == best))
    report.write.mode("overwrite").json(f"{path}/report")
    evaluation.per_class_metrics(judged, best).write.mode("overwrite").json(f"{path}/report_per_class")
    return spark.read.json(f"{path}/report")
