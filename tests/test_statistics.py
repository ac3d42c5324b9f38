"""Cleaning, bins, metrics, selection, models, sequences, store, sources, streams."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import binning, cleaning, metrics, models, selection, sequence
from chronolith.plans.store import FeatureStore
from chronolith.sources import tables as sources
from chronolith.spec import Roles

ROLES = Roles()


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([(k, float(round(p, 2)), int(rng.random() < p)) for k, p in enumerate(rng.random(400))], "id long, p double, y int")


def test_cleaner(spark):
    df = spark.createDataFrame([(k, float(k), 1, None if k % 2 else 2.0) for k in range(101)], "id long, x double, same int, part double")
    state = cleaning.fit_cleaner(df, exclude=["id"])
    assert state.constant == ["same", "part"] and state.stats["x"]["median"] == 50
    out = cleaning.clean(spark.createDataFrame([(1, None, 1, None), (2, 1000.0, 1, 1.0)], df.schema), state).orderBy("id").collect()
    assert out[0]["x"] == 50 and out[1]["x"] == 99 and out[1]["x_clip_high"] == 1 and "same" not in out[0].asDict()
    assert cleaning.cleaning_summary(df, state).count() == 3


def test_chi_merge_invariants(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), int(rng.random() < (0.1 if x < 0 else 0.6))) for x in np.concatenate([rng.normal(-3, 1, 950), rng.normal(3, 1, 50)])]
    df = spark.createDataFrame([*rows, (None, 1)], "x double, y int")
    for most in (2, 3, 5, 8):
        edges = binning.chi_merge(df, "x", "y", most)
        assert edges[0] == -math.inf and edges[-1] == math.inf and len(edges) - 1 <= most and edges == sorted(set(edges))
    assert binning.chi_merge(df.limit(0), "x", "y") == [-math.inf, math.inf]
    assert binning.chi_square((10, 0), (5, 0)) == math.inf


def test_psi_of_the_same_table_is_zero(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    row = binning.stability(df, df, ["x", "absent"]).orderBy("feature").collect()
    assert row[0]["psi"] == 0 and abs(row[1]["psi"]) < 1e-12 and not row[1]["drifted"]


def test_metrics_against_brute_force(spark, scored):
    rows = [(r["p"], r["y"], r["id"]) for r in scored.collect()]
    pos, neg = [p for p, y, _ in rows if y], [p for p, y, _ in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(scored, "p", "y").first()[0], auc)
    ks = max(abs(sum(x >= t for x in pos) / len(pos) - sum(x >= t for x in neg) / len(neg)) for t, _, _ in rows)
    assert math.isclose(metrics.kolmogorov_smirnov(scored, "p", "y").first()[0], ks)
    top = sorted(rows, key=lambda r: (-r[0], r[2]))[:20]
    assert math.isclose(metrics.precision_at(scored, "p", "y", "id", 0.05).first()["precision"], sum(y for _, y, _ in top) / 20)
    best = metrics.best_threshold(scored, "p", "y").first()
    cost = lambda t: 10 * sum(p >= t and not y for p, y, _ in rows) + 500 * sum(p < t and y for p, y, _ in rows)
    assert best["cost"] == min(cost(k / 100) for k in range(1, 100)) == cost(best["threshold"])
    assert metrics.roc_auc(scored.limit(0), "p", "y").first()[0] is None


def test_calibration_improves_or_keeps_the_error(spark, scored):
    off = scored.withColumn("q", F.col("p") * 0.3)
    iso = models.fit_isotonic(off, "q", "y").transform(off, "q", "c")
    platt = models.fit_platt(off, "q", "y").transform(off, "q", "c")
    before = metrics.calibration_error(off, "q", "y").first()[0]
    assert metrics.calibration_error(iso, "c", "y").first()[0] < before and metrics.calibration_error(platt, "c", "y").first()[0] < before
    assert iso.where("c < 0 or c > 1").count() == 0


def test_vif_drops_what_the_others_give(spark):
    df = spark.range(200).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.col("a") * 2 + F.col("b"))
    left, dropped = selection.filter_by_vif(df, ["a", "b", "c"], iv={"a": 0.5, "b": 0.4, "c": 0.1})
    assert left == ["a", "b"] and dropped[0][0] == "c" and math.isinf(dropped[0][1])


def test_trees(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("z")).withColumn("y", ((F.col("x") > 9) & (F.col("z") > 2)).cast("int"))
    classifier = models.fit(df, ["x", "z"], "y", "gbt", maxIter=3, maxDepth=3)
    nodes = models.tree_nodes(classifier, spark, str(tmp_path / "trees")).cache()
    paths = models.tree_paths(nodes).cache()
    assert paths.count() == nodes.where("left < 0").count() and models.tree_rules(paths, 2).groupBy("tree_id").count().where("count > 2").count() == 0
    assert models.tree_depths(nodes, paths).where("feature = 'x'").count() == 1 and models.tree_interactions(paths, 1).count() == 1
    some = df.where("id < 5")
    traced = {r["id"]: r["m"] for r in models.trace(nodes, some, "id").groupBy("id").agg(F.sum("value").alias("m")).collect()}
    explained = models.explain(nodes, some, "id")
    base = nodes.where("node_id = 0").agg(F.sum(F.col("value") * F.col("weight"))).first()[0]
    summed = {r["id"]: r["s"] + base for r in explained.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    scores = {r["id"]: r["p"] for r in classifier.score(some).collect()}
    for k, margin in traced.items():
        assert math.isclose(summed[k], margin, abs_tol=1e-9) and math.isclose(scores[k], 1 / (1 + math.exp(-2 * margin)), abs_tol=1e-9)
    assert {r["feature"] for r in models.global_importance(explained).collect()} <= {"x", "z"}
    assert metrics.roc_auc(classifier.score(df), "p", "y").first()[0] > 0.99
    with pytest.raises(ValueError):
        models.make_model("other")


def test_sequences(spark):
    rows = [(1, 1, 1000, 1.0), (2, 1, 2000, None), (3, 1, 3000, 3.0), (4, 2, 1500, 4.0), (5, 2, 2500, 5.0), (6, 3, 1800, 6.0)]
    df = spark.createDataFrame(rows, "id long, key int, t long, amt double")
    tail = {r["key"]: r["sequence"] for r in sequence.sequence_tail(df, ROLES, ["amt"], 2).collect()}
    assert tail == {1: [[0.0], [3.0]], 2: [[4.0], [5.0]], 3: [[6.0]]}
    encoder = sequence.fit_encoder(df, ROLES, ["amt"], 2, 2)
    embedded = encoder.transform(df, ROLES)
    assert embedded.where("anomaly is null").count() == 0 and embedded.count() == 3
    out = sequence.join_embedding(spark.createDataFrame([(1, 1), (2, 99)], "id long, key int"), embedded, "key", 2)
    assert out.where("seq_emb_0 is null or seq_anomaly is null").count() == 0 and dict(out.dtypes)["seq_emb_0"] == "float"


def test_feature_store(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path / "store"))
    assert store.register("amt_log", "card", raw_columns=["TransactionAmt"]) == 1
    assert store.register("amt_agg", "card", upstream=["amt_log"]) == 1 and store.register("amt_log", "card", raw_columns=["TransactionAmt"]) == 2
    assert store.versions("amt_log").where("is_active").count() == 1 and store.active("amt_log")["version"] == 2
    assert store.upstream("amt_agg", True) == ["TransactionAmt", "amt_log"] and store.upstream("amt_agg") == ["amt_log"] and store.downstream("amt_log") == ["amt_agg"] and store.upstream("alone") == []
    assert not store.has_cycle()
    store.rollback("amt_log", 1)
    assert store.active("amt_log")["version"] == 1
    with pytest.raises(ValueError):
        store.rollback("amt_log", 9)
    with pytest.raises(KeyError):
        store.feature("nothing")
    store.archive("amt_agg")
    assert [r["name"] for r in store.features().collect()] == ["amt_log"] and store.features(archived=True).count() == 2
    store.record_statistics("amt_log", spark.range(5).select(F.col("id").cast("double").alias("amt_log")))
    again = FeatureStore(spark, str(tmp_path / "store"))
    assert again.table("statistics").first()["n_unique"] == 5 and again.feature("amt_log")["version"] == 1
    store.register("amt_log", "card", upstream=["amt_agg"])
    assert store.has_cycle()


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 70000, "x"), (2, 5, None)], "small long, wide long, id_1 string")
    for name in ("a.parquet", "a.csv", "a.json"):
        sources.write(df, str(tmp_path / name))
        assert sources.read(spark, str(tmp_path / name), df.schema).count() == 2
    types = {f.name: f.dataType.simpleString() for f in sources.fitted_types(df)}
    assert types == {"small": "tinyint", "wide": "int", "id_1": "string"}
    cast = sources.apply_schema(spark.createDataFrame([("7", "q")], "small string, wide string"), sources.save_schema(df)).first()
    assert cast["small"] == 7 and cast["wide"] is None
    (tmp_path / "list.txt").write_text("# comment\n\n 12 \n34\n")
    assert sorted(r[0] for r in sources.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["12", "34"]
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path / "a.xyz"))
