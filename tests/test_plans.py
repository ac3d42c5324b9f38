"""Schemas of steps, reports of a training run, and a feature store with several writers."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from chronolith.plans import features, training
from chronolith.plans.store import FeatureStore
from chronolith.spec import Roles


def test_steps_tell_what_they_take(spark):
    history = features.schema_of("history")
    assert [(p["name"], p["required"]) for p in history["parameters"]] == [("windows", False), ("stats", False), ("columns", False)]
    assert history["needs_history"] and not history["is_stateful"] and history["parameters"][0]["default"] == (3600,) and history["example"] == "history"
    target = features.schema_of("target_encoding")
    assert target["is_stateful"] and target["depends_on_target"] and target["example"] == {"target_encoding": {"column": "<column>"}}
    table = features.schemas(spark)
    assert {r["step"] for r in table.select("step").collect()} == set(features.STEPS) and table.where("description is null or description = ''").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        features.schema_of("none")
    # each example is an entry that a plan takes
    assert len(features.configure([features.schema_of(s)["example"] for s in features.STEPS])) == len(features.STEPS)


def test_a_training_run_makes_its_reports(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 11).alias("key"), (F.col("id") * 60).alias("t"), ((F.col("id") * 37) % 100).cast("double").alias("amt")).withColumns({"y": (F.col("amt") > 60).cast("int"), "twice": F.col("amt") * 2})
    trained = training.train(df, Roles(), ["amount", {"history": {"windows": [3600]}}], vif=10.0, report=True, maxIter=3, maxDepth=2)
    assert set(trained.reports) == {"iv_scores", "psi_drift", "cleaning", "vif_history", "feature_importance", "split_depths"}
    dropped = [r["column"] for r in trained.reports["vif_history"].orderBy("step").collect()]
    assert {"amt", "twice"} & set(dropped) and not set(dropped) & set(trained.classifier.columns)
    trained.save(str(tmp_path / "run"))
    for name in [*trained.reports, "metrics"]:
        assert (tmp_path / "run" / "reports" / name).exists(), name
    importance = spark.read.csv(str(tmp_path / "run" / "reports" / "feature_importance"), header=True)
    assert importance.count() == len(trained.classifier.columns)
    again = training.Trained.load(spark, str(tmp_path / "run"))
    assert {r["id"]: r["probability"] for r in again.score(df).collect()} == pytest.approx({r["id"]: r["probability"] for r in trained.score(df).collect()})


def test_writers_of_a_store_take_turns(spark, tmp_path):
    path, errors = str(tmp_path / "store"), []

    def work(k):
        try:
            store = FeatureStore(spark, path)
            for _ in range(2):
                store.register(f"feature_{k}", "card", raw_columns=[f"c{k}"])
            store.register("shared", "card")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    store = FeatureStore(spark, path)
    assert [r["name"] for r in store.features().collect()] == ["feature_0", "feature_1", "feature_2", "shared"]
    versions = store.table("feature_versions").collect()
    assert len({r["version_id"] for r in versions}) == len(versions) == 9
    assert sorted(r["version"] for r in versions if r["feature_name"] == "shared") == [1, 2, 3]
    assert store.upstream("feature_1") == ["c1"]


def test_a_dead_writer_is_passed_over(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"), wait=0.5)
    store.register("a", "card")
    # claims whose writers never came to an end
    for name in ("features", "feature_versions"):
        newest = max(store._versions(name))
        (tmp_path / "store" / name / f"claim-{newest + 1}").write_text("")
    assert store.register("b", "card") == 1 and [r["name"] for r in store.features().collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="no version"):
        store.activate(99)
    assert store.register("b", "card") == 2
