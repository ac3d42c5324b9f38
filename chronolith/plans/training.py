"""From raw events to a scored, calibrated model, and batch scoring with it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import binning, cleaning, metrics, models, rules, selection, shapley, tables
from chronolith.plans.features import FeaturePlan, configure
from chronolith.spec import Roles
from chronolith.storage import new_path, written


@dataclass
class Trained:
    """What scoring needs."""

    roles: Roles
    plan: FeaturePlan
    cleaner: cleaning.CleanerState
    classifier: models.Classifier
    calibrator: object
    tiers: tuple[float, float]
    metrics: DataFrame | None = None
    steps: list = field(default_factory=list)
    #: Reports of the training run by name, where they were asked for.
    reports: dict[str, DataFrame] = field(default_factory=dict)

    def score(self, df: DataFrame, version: str = "1") -> DataFrame:
        """``(id, probability, risk_level, action, binary_prediction, model_version, scored_at)`` of all rows at once."""
        tables.require(df, [self.roles.key, self.roles.time, self.roles.id, self.roles.amount])
        return self.score_features(self.plan.transform(df), version)

    def score_features(self, featured: DataFrame, version: str = "1") -> DataFrame:
        """:meth:`score` of rows that have the plan's columns."""
        ready = cleaning.clean(featured, self.cleaner)
        scored = self.calibrator.transform(self.classifier.score(ready, "_raw"), "_raw", "probability")
        tiered = metrics.assign_tiers(scored, "probability", *self.tiers)
        return tiered.select(F.col(self.roles.id).alias("id"), "probability", "risk_level", "action", (F.col("probability") > self.tiers[1]).cast("int").alias("binary_prediction"), F.lit(version).alias("model_version"), F.current_timestamp().alias("scored_at"))

    def score_and_explain(self, df: DataFrame, top: int = 5, version: str = "1") -> DataFrame:
        """:meth:`score` with ``base``, ``margin``, ``contributions`` and ``reasons``: Shapley values of the model's margin, for tree models.

        Features are made once.  Ids must be unique: scores and explanations meet by id.
        """
        featured = written(self.plan.transform(df), "featured")
        nodes = written(models.tree_nodes(self.classifier, df.sparkSession, new_path(df.sparkSession, "trees")), "nodes")
        explained = shapley.strongest(shapley.shapley(nodes, cleaning.clean(featured, self.cleaner), self.roles.id), top)
        return self.score_features(featured, version).join(explained, "id")

    def score_with_rules(self, df: DataFrame, engine: rules.RuleEngine, history: DataFrame | None = None) -> DataFrame:
        """Rules first; only rows that no rule decides take the model's probability.

        ``history`` holds earlier rows of the same columns, which windows may
        look at; ``features_degraded`` marks rows that the model scored without
        any though its features need it.
        """
        if history is not None:
            both = df.withColumn("_new", F.lit(True)).unionByName(history.withColumn("_new", F.lit(False)), allowMissingColumns=True)
            new = both.where("_new").select(F.col(self.roles.id).alias("_id"))
            return self.score_with_rules(both.drop("_new"), engine).drop("features_degraded").join(new, F.col("id") == F.col("_id"), "left_semi").withColumn("features_degraded", F.lit(False))
        ruled = engine.evaluate(df, self.roles).select(F.col(self.roles.id).alias("_id"), "rule", "rule_action")
        scored = self.score(df).select("id", F.col("probability").alias("score"))
        decided = rules.decide(scored.join(ruled, F.col("id") == F.col("_id")).drop("_id"), "score", *self.tiers)
        return decided.withColumn("features_degraded", F.col("rule").isNull() & F.lit(self.plan.needs_history))

    def save(self, path: str) -> None:
        """``online_artifacts`` (fitted steps, model, settings) and ``reports`` (metrics) below ``path``."""
        spark = SparkSession.getActiveSession()
        self.plan.save(f"{path}/online_artifacts/steps")
        self.classifier.save(f"{path}/online_artifacts/model")
        settings = {"roles": asdict(self.roles), "steps": self.steps, "constant": self.cleaner.constant, "stats": self.cleaner.stats, "columns": self.classifier.columns, "platt": [self.calibrator.slope, self.calibrator.intercept], "tiers": list(self.tiers)}
        spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/online_artifacts/settings")
        for name, report in self.reports.items():
            report.coalesce(1).write.mode("overwrite").csv(f"{path}/reports/{name}", header=True)
        if self.metrics is not None:
            self.metrics.coalesce(1).write.mode("overwrite").csv(f"{path}/reports/metrics", header=True)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Trained:
        at = f"{path}/online_artifacts"
        s = json.loads(spark.read.text(f"{at}/settings").first()[0])
        roles = Roles(**s["roles"])
        plan = FeaturePlan(configure(s["steps"]), roles).load(spark, f"{at}/steps")
        classifier = models.Classifier(s["columns"], PipelineModel.load(f"{at}/model").stages[0])
        return Trained(roles, plan, cleaning.CleanerState(s["constant"], s["stats"]), classifier, models.PlattCalibrator(*s["platt"]), tuple(s["tiers"]), None, s["steps"])


def train(df: DataFrame, roles: Roles, steps: Sequence[str | dict], ratio: float = 0.2, kind: str = "gbt", iv: float = 0.0, vif: float | None = None, report: bool = False, **params) -> Trained:
    """Split by time, fit features and cleaning on the older part, select, train, calibrate, and find tiers on the newer.

    With ``vif``, columns that the others explain are left out one by one.  With
    ``report``, the run's reports are made: information values, the columns left out
    for their variance inflation, stability between the parts, cleaning, and for tree models importance and split depths.
    """
    split = written(tables.time_split(df, [roles.time, roles.id], ratio), "split")
    older, newer = split.where("not is_val").drop("is_val"), split.where("is_val").drop("is_val")
    plan = FeaturePlan(configure(steps), roles)
    made = written(plan.fit_transform(older), "features")
    fixed = [roles.id, roles.key, roles.time, roles.target]
    state = cleaning.fit_cleaner(made, exclude=fixed)
    ready = written(cleaning.clean(made, state), "cleaned")
    columns = [c for c in cleaning.numeric_columns(ready) if c not in fixed]
    if iv > 0:
        columns = selection.select_by_iv(ready, roles.target, iv, exclude=fixed)[1] or columns
    asked, dropped = list(columns), []
    if vif is not None:
        columns, dropped = selection.filter_by_vif(ready, columns, vif)
    classifier = models.fit(ready, columns, roles.target, kind, **params)
    held = written(classifier.score(cleaning.clean(plan.transform(newer), state), "_raw"), "held-out")
    reports = run_reports(ready, held, state, classifier, asked, dropped, roles, kind) if report else {}
    calibrator = models.fit_platt(held, "_raw", roles.target)
    scored = calibrator.transform(held, "_raw", "p")
    best = metrics.best_tiers(scored, "p", roles.target).first()
    return Trained(roles, plan, state, classifier, calibrator, (best["low"], best["high"]), models.evaluate(scored, "p", roles.target), list(steps), reports)


def run_reports(ready: DataFrame, held: DataFrame, state: cleaning.CleanerState, classifier: models.Classifier, columns: Sequence[str], dropped: Sequence[tuple[str, float]], roles: Roles, kind: str) -> dict[str, DataFrame]:
    """Tables by name, each of a row or a few for a column."""
    spark = ready.sparkSession
    out = {
        "iv_scores": binning.information_values(ready, columns, roles.target),
        "psi_drift": binning.stability(ready, held, columns),
        "cleaning": cleaning.cleaning_summary(ready, state),
        "vif_history": spark.createDataFrame([(k, c, float(v)) for k, (c, v) in enumerate(dropped)], "step int, column string, vif double"),
    }
    if kind in ("gbt", "random_forest"):
        nodes = written(models.tree_nodes(classifier, spark, new_path(spark, "trees")), "nodes")
        out |= {"feature_importance": classifier.importance(spark), "split_depths": models.depth_report(nodes).withColumn("depths", F.to_json("depths"))}
    return out
