"""Shapley values against all subsets of features."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import models, shapley
from chronolith.plans import training
from chronolith.spec import Roles
from chronolith.storage import written

NODES = "tree_id int, node_id int, left int, right int, feature string, threshold double, gain double, value double, n long, weight double"


def _tree(rng, tree, depth, features):
    """A random tree whose paths repeat features."""
    rows = []

    def grow(level, n):
        at = len(rows)
        rows.append(None)
        if level == depth or n < 2 or (level and rng.random() < 0.15):
            rows[at] = (tree, at, -1, -1, None, None, None, float(rng.normal()), n, 0.5 + tree)
            return at
        left_n = int(rng.integers(1, n))
        left = grow(level + 1, left_n)
        right = grow(level + 1, n - left_n)
        rows[at] = (tree, at, left, right, str(rng.choice(features)), float(rng.normal()), 1.0, float(rng.normal()), n, 0.5 + tree)
        return at

    grow(0, 200)
    return rows


def _given(own, x, known, at=0):
    """The expected value of a tree when ``known`` features of ``x`` are known."""
    _, _, left, right, feature, threshold, _, value, n, weight = own[at]
    if left < 0:
        return value * weight
    if feature in known:
        return _given(own, x, known, left if x[feature] <= threshold else right)
    return (own[left][8] * _given(own, x, known, left) + own[right][8] * _given(own, x, known, right)) / (own[left][8] + own[right][8])


def _brute(trees, x, features):
    d = len(features)
    value = lambda s: sum(_given(t, x, s) for t in trees)
    return {f: sum(factorial(k) * factorial(d - 1 - k) / factorial(d) * (value({*s, f}) - value(set(s))) for k in range(d) for s in combinations([g for g in features if g != f], k)) for f in features}


def test_shapley_values_are_those_of_all_subsets(spark):
    rng = np.random.default_rng(3)
    features = ["a", "b", "c", "d", "e"]
    trees = [_tree(rng, k, depth, features) for k, depth in enumerate((6, 4, 1, 0))]
    nodes = spark.createDataFrame([r for t in trees for r in t], NODES)
    rows = [(k, *[float(v) for v in rng.normal(size=5)], "x") for k in range(12)]
    rows += [(12, None, float("nan"), 0.0, 1e9, -1e9, "x"), (12, None, float("nan"), 0.0, 1e9, -1e9, "x")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, margin string")
    got = shapley.shapley(nodes, df, "id").collect()
    assert len(got) == 14
    for r in got:
        x = {f: (v if v is not None and v == v else 0.0) for f, v in zip(features, rows[r["id"]][1:6], strict=True)}
        want = _brute(trees, x, features)
        assert {c["feature"]: pytest.approx(c["contribution"], abs=1e-9) for c in r["contributions"]} == want
        assert r["margin"] == pytest.approx(sum(_given(t, x, set(features)) for t in trees)) and r["base"] == pytest.approx(sum(_given(t, x, set()) for t in trees))
    assert shapley.shapley(nodes, df.limit(0), "id").count() == 0
    top = shapley.strongest(shapley.shapley(nodes, df, "id"), 2).first()
    sizes = sorted((abs(c["contribution"]) for c in top["contributions"]), reverse=True)
    assert [abs(c["contribution"]) for c in top["reasons"]] == sizes[:2]
    absent = shapley.shapley(nodes, df.drop("c"), "id").count()
    assert absent == 14


def test_margins_are_those_of_the_models(spark, tmp_path):
    df = spark.range(400).select("id", ((F.col("id") * 37) % 100).cast("double").alias("a"), ((F.col("id") * 53) % 71).cast("double").alias("b")).withColumn("y", ((F.col("a") > 60) | (F.col("b") > 60)).cast("int"))
    for kind, params in (("gbt", {"maxIter": 4, "maxDepth": 3}), ("random_forest", {"numTrees": 5, "maxDepth": 4})):
        classifier = models.fit(df, ["a", "b"], "y", kind, **params)
        nodes = written(models.tree_nodes(classifier, spark, str(tmp_path / kind)), "nodes")
        p = {r["id"]: r["p"] for r in classifier.score(df).collect()}
        for r in shapley.shapley(nodes, df, "id").collect():
            total = r["base"] + sum(c["contribution"] for c in r["contributions"])
            assert total == pytest.approx(r["margin"])
            assert (1 / (1 + np.exp(-2 * total)) if kind == "gbt" else total) == pytest.approx(p[r["id"]], abs=1e-9)
        found = {r["feature"]: r for r in shapley.summary(shapley.shapley(nodes, df, "id")).collect()}
        assert set(found) == {"a", "b"} and all(0 < r["importance"] for r in found.values())


def test_score_and_explain_in_one_call(spark):
    df = spark.range(300).select("id", (F.col("id") % 11).alias("key"), (F.col("id") * 60).alias("t"), ((F.col("id") * 37) % 100).cast("double").alias("amt")).withColumn("y", (F.col("amt") > 60).cast("int"))
    trained = training.train(df, Roles(), ["amount", {"history": {"windows": [3600]}}], maxIter=3, maxDepth=2)
    told = {r["id"]: r for r in trained.score_and_explain(df, top=1).collect()}
    scored = {r["id"]: r for r in trained.score(df).collect()}
    assert told.keys() == scored.keys()
    for k, r in told.items():
        assert r["probability"] == pytest.approx(scored[k]["probability"]) and r["action"] == scored[k]["action"]
        raw = 1 / (1 + np.exp(-2 * r["margin"]))
        assert 1 / (1 + np.exp(-(trained.calibrator.slope * raw + trained.calibrator.intercept))) == pytest.approx(r["probability"])
        assert r["reasons"][0]["feature"] in ("amt", "log_amount")


def test_depths_and_summary_of_trees(spark):
    rng = np.random.default_rng(9)
    trees = [_tree(rng, k, depth, ["a", "b", "c"]) for k, depth in enumerate((5, 3, 0))]
    nodes = spark.createDataFrame([r for t in trees for r in t], NODES)
    depth, splits = {}, []
    for k, own in enumerate(trees):
        stack = [(0, 0)]
        while stack:
            at, d = stack.pop()
            depth[k, at] = d
            if own[at][2] >= 0:
                splits.append((k, own[at][4], d))
                stack += [(own[at][2], d + 1), (own[at][3], d + 1)]
    assert {(r["tree_id"], r["node_id"]): r["depth"] for r in models.node_depths(nodes).collect()} == depth
    for r in models.depth_report(nodes).collect():
        own = [s for s in splits if s[1] == r["feature"]]
        assert r["splits"] == len(own) and r["tree_share"] == pytest.approx(len({s[0] for s in own}) / 3)
        assert (r["min_depth"], r["max_depth"]) == (min(s[2] for s in own), max(s[2] for s in own)) and r["avg_depth"] == pytest.approx(np.mean([s[2] for s in own]))
        assert r["depths"] == {d: sum(s[2] == d for s in own) for d in {s[2] for s in own}}
    whole = models.tree_summary(nodes, 2).first()
    leaves = [k for k, d in depth.items() if trees[k[0]][k[1]][2] < 0]
    assert (whole["trees"], whole["leaves"], whole["splits"], whole["max_depth"]) == (3, len(leaves), len(splits), max(depth[k] for k in leaves))
    assert whole["total_gain"] == len(splits) and len(whole["top_features"]) == 2
    assert whole["top_features"][0]["share"] == pytest.approx(max(sum(s[1] == f for s in splits) for f in "abc") / len(splits))
