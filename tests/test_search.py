"""Parameter search: draws, halving, and a planted optimum."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolith.operators import search

SPACE = {"depth": ("int", 1, 6), "rate": ("log", 1e-4, 1.0), "share": ("float", 0.2, 0.9), "kind": ("choice", ["a", "b"])}


def test_draws_are_seeded_and_in_range():
    one = search.draw(SPACE, 200, 5)
    assert one == search.draw(dict(reversed(SPACE.items())), 200, 5) and one != search.draw(SPACE, 200, 6)
    assert {t["depth"] for t in one} == set(range(1, 7)) and {t["kind"] for t in one} == {"a", "b"}
    assert all(1e-4 <= t["rate"] <= 1 and 0.2 <= t["share"] <= 0.9 for t in one)
    # even in the logarithm: about half lie below the middle of it
    assert 70 < sum(t["rate"] < 1e-2 for t in one) < 130
    for bad in ({"x": ("int", 3, 2)}, {"x": ("log", 0, 1)}, {"x": ("choice", [])}, {"x": ("none", 1, 2)}):
        with pytest.raises(ValueError):
            search.draw(bad, 1)


def test_halving_keeps_the_best_and_finds_a_planted_optimum():
    asked = []

    def objective(p, budget):
        asked.append(budget)
        return float("nan") if p["kind"] == "b" and p["depth"] == 1 else -abs(p["depth"] - 4) - abs(p["rate"] - 0.1) - 1 / budget

    trials = search.draw(SPACE, 27, 1)
    results = search.halving(trials, objective, 1, 27, 3)
    assert [asked.count(b) for b in (1, 3, 9, 27)] == [27, 9, 3, 1]
    assert search.best(results).params == min(trials, key=lambda p: abs(p["depth"] - 4) + abs(p["rate"] - 0.1))
    same = search.halving([{"k": 1}, {"k": 2}], lambda p, b: 0.5, 1, 3)
    assert search.best(same).trial == 0


def test_search_over_purged_folds(spark):
    # two signs that only deeper trees can join
    df = spark.range(600).select("id", F.col("id").alias("t"), ((F.xxhash64("id") % 97) / 97.0).alias("a"), ((F.xxhash64("id", F.lit(1)) % 89) / 89.0).alias("b")).withColumn("y", ((F.col("a") > 0) == (F.col("b") > 0)).cast("int"))
    found, results = search.search(df, ["a", "b"], "y", ["t", "id"], {"maxDepth": ("choice", [0, 5])}, "random_forest", trials=3, budget=("numTrees", 2, 4), factor=2, seed=2)
    assert {r.params["maxDepth"] for r in results} == {0, 5} and found == {"maxDepth": 5, "numTrees": 4}
    rows = search.report(spark, results).collect()
    assert len(rows) == len(results) and max(r["score"] for r in rows) > 0.8


def test_a_task_of_training_holds_a_bounded_number_of_values(spark, monkeypatch):
    from chronolith.operators import models

    seen = []
    monkeypatch.setattr(models, "TASK_VALUES", 100, raising=False)
    monkeypatch.setattr(models.RandomForestClassifier, "_fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()))
    df = spark.range(500).coalesce(1).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"), (F.col("id") % 2).alias("y"))
    models.fit(df, ["a", "b"], "y", "random_forest")
    assert sum(seen[0]) == 500 and max(seen[0]) * 2 <= 100
