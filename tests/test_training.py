"""Training, artifacts and the batch job, end to end on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronolith.operators.rules import Amount, RuleEngine
from chronolith.plans import batch, training
from chronolith.spec import Roles

ROLES = Roles()


def test_train_save_load_score(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 11).alias("key"), (F.col("id") * 60).alias("t"), ((F.col("id") * 37) % 100).cast("double").alias("amt")).withColumn("y", (F.col("amt") > 60).cast("int"))
    trained = training.train(df, ROLES, ["amount", {"history": {"windows": [3600]}}, {"uid": {"columns": ["key"]}}, "missing_pattern"], maxIter=3, maxDepth=2)
    assert trained.metrics.first()["auc"] > 0.95
    scored = trained.score(df)
    assert scored.count() == 400 and set(scored.columns) == {"id", "probability", "risk_level", "action", "binary_prediction", "model_version", "scored_at"}
    ruled = trained.score_with_rules(df, RuleEngine([Amount(90.0)]))
    assert ruled.where("decision_source = 'rule'").count() == df.where("amt > 90").count()
    path = str(tmp_path / "artifacts")
    trained.save(path)
    df.write.parquet(str(tmp_path / "in.parquet"))
    arguments = ["--artifacts", path, "--input", str(tmp_path / "in.parquet"), "--output", str(tmp_path / "out.parquet")]
    assert batch.main(arguments) == 0
    again = {r["id"]: r["probability"] for r in spark.read.parquet(str(tmp_path / "out.parquet")).collect()}
    assert all(abs(again[r["id"]] - r["probability"]) < 1e-12 for r in scored.collect())
    assert batch.main([]) == 2 and batch.main(["--artifacts", "/nowhere", *arguments[2:]]) == 3 and batch.main([*arguments[:2], "--input", "/nowhere.parquet", *arguments[4:]]) == 4
