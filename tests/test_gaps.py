"""Plans, catalogue, bins, encoder, streams: what other tests do not call."""

from __future__ import annotations

import importlib
import sys

import pytest
from pyspark.sql import functions as F

from chronolith.operators import binning, cleaning, models, selection, sequence
from chronolith.operators.rules import Amount, Blacklist, RuleEngine, Velocity
from chronolith.plans.feature_catalog import FeatureCatalog
from chronolith.plans.features import FeaturePlan, configure
from chronolith.plans.store import FeatureStore, upstream
from chronolith.sources import tables as sources
from chronolith.spec import Roles
from chronolith.streaming import stateful

ROLES = Roles()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).select("id", (F.col("id") % 6).alias("key"), (F.col("id") * 60).alias("t"), ((F.col("id") * 37) % 100).cast("double").alias("amt")).withColumn("y", (F.col("amt") > 60).cast("int"))


def test_entry_imports_without_a_library_of_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("chronolith.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "history_window" in names and not any(n.startswith("op1_") for n in names) and "pipeline" not in names
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_steps_with_clashing_columns_are_an_error_and_instances_are_named(rows):
    with pytest.raises(ValueError, match="already"):
        FeaturePlan(configure(["velocity", "amount", "amount"]), ROLES).fit_transform(rows)
    plan = FeaturePlan(configure(["amount", {"amount": {"instance": "again"}}]), ROLES)
    out = plan.fit_transform(rows)
    assert {"log_amount", "log_amount_again"} <= set(out.columns) and out.where("log_amount <> log_amount_again").count() == 0
    assert plan.transform(rows).columns == out.columns and plan.needs_history and not FeaturePlan(configure(["time"]), ROLES).needs_history


def test_catalogue_goes_to_json_and_to_the_store(spark, rows, tmp_path):
    plan = FeaturePlan(configure(["time", {"target_encoding": {"column": "key"}}]), ROLES)
    plan.fit_transform(rows)
    catalogue = FeatureCatalog(plan.entries(), "run")
    assert catalogue.stateful() == catalogue.target_dependent() == ["target_encoding"] and len(catalogue.of_source("time")) > 1
    catalogue.export(spark, str(tmp_path / "c"))
    assert FeatureCatalog.load(spark, str(tmp_path / "c")).to_dict() == catalogue.to_dict()
    store = FeatureStore(spark, str(tmp_path / "store"))
    catalogue.to_store(store)
    assert {r["name"] for r in store.features().collect()} == {"time", "target_encoding"}
    store.register("amt", "transaction")
    store.record_statistics("amt", rows, target="y")
    found = store.table("statistics").first()
    want = binning.information_values(rows, ["amt"], "y").first()["iv"]
    assert want > 0 and found["iv_score"] == want
    assert cleaning.feature_stats(rows, ["amt"]).columns[-1] == "p95"


def test_lineage_deeper_than_asked_is_an_error(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(6)], "name string, source_name string")
    assert upstream(edges, "0", True) == ["1", "2", "3", "4", "5", "6"] and upstream(edges, "0") == ["1"]
    with pytest.raises(ValueError):
        upstream(edges, "0", True, 3)


def test_a_single_value_is_cut_in_equal_widths(spark):
    df = spark.createDataFrame([(5.0, k % 2) for k in range(10)], "x double, y int")
    table = binning.woe_table(df, ["x"], "y", 4).orderBy("bin").collect()
    assert len(table) == 4 and sum(r["count"] for r in table) == 10 and binning.information_values(df, ["x"], "y").first()["iv"] == 0
    assert binning.width_edges(spark.createDataFrame([(0.0,), (8.0,)], "x double"), ["x"], 4) == {"x": [0.0, 2.0, 4.0, 6.0, 8.0]}


def test_encoder_survives_saving(spark, rows, tmp_path):
    encoder = sequence.fit_encoder(rows, ROLES, ["amt", "y"], 5, 3)
    encoder.save(str(tmp_path / "e"))
    one, two = (x.transform(rows, ROLES).orderBy("key").collect() for x in (encoder, sequence.SequenceEncoder.load(spark, str(tmp_path / "e"))))
    assert one == two


def test_selection_drift_and_search(spark, rows):
    moved = rows.withColumn("amt", F.col("amt") + 500)
    verdict, telling = selection.adversarial_validation(rows.withColumn("z", F.col("id") % 3), moved.withColumn("z", F.col("id") % 3), ["amt", "z"], "id", permute=True)
    assert verdict.first()["shifted"] and telling.first()["feature"] == "amt"
    found = {r["feature"]: r for r in selection.drift(rows, moved, ["amt"], "id").collect()}
    assert found["amt"]["by_model"]
    assert selection.sample_rows(rows, 50, "id").count() == 50
    kept = selection.select_by_iv(rows.withColumn("flat", F.lit(1.0)), "y", 0.5, exclude=["id", "key", "t", "y"])[1]
    assert kept == ["amt"]


def test_readers_and_writers(spark, rows, tmp_path):
    for part in ("transaction", "identity"):
        rows.limit(3).write.parquet(str(tmp_path / f"train_{part}.parquet"))
    assert [d.count() for d in sources.load_pair(spark, str(tmp_path), "train")] == [3, 3]
    for _ in range(2):
        sources.append_scores(rows.select("id"), path=str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 480
    sources.write_report(rows.limit(2), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 2
    parsed = stateful.parse_events(spark.createDataFrame([('{"id": 3}',), ("broken",)], "value string"), "id long").collect()
    assert [r["id"] for r in parsed] == [3, None]


def _run(frame, path, checkpoint):
    frame.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_rules_in_a_stream_count_what_the_rules_before_let_through(spark, tmp_path):
    schema = "id long, key long, t long, amt double, card string"
    rows = [(k, k % 2, k * 10, 5.0 if k % 7 else 5e4, "bad" if k % 3 == 0 else "good") for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    engine = RuleEngine([Blacklist("card", spark.createDataFrame([("bad",)], "value string")), Velocity(100, 3), Amount(1000.0)])
    stream = stateful.read_events(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], schema).schema, 1)
    stateful.rule_stream(stream, engine, ROLES, str(tmp_path / "sink"), str(tmp_path / "cp"), 100).awaitTermination()
    got = {r["id"]: r["rule"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    want = {r["id"]: r["rule"] for r in engine.evaluate(spark.createDataFrame(rows, schema), ROLES).collect()}
    assert got == want and set(want.values()) == {"blacklist", "velocity", "amount", None}


def test_scores_of_a_stream_and_blocked_rows(spark, rows, tmp_path):
    rows.limit(20).write.parquet(str(tmp_path / "in" / "a"))
    (tmp_path / "list.txt").write_text("1\n")
    stream = stateful.blocked(stateful.read_events(spark, str(tmp_path / "in" / "*"), rows.schema), "key", str(tmp_path / "list.txt"))
    query = stateful.score_stream(stream, lambda b: b.select("id", "is_blocked"), str(tmp_path / "sink"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    out = spark.read.parquet(str(tmp_path / "sink"))
    assert out.count() == 20 and out.where("is_blocked").count() == rows.limit(20).where("key = 1").count()


def test_models_are_compared_and_searched(rows):
    parts = [p for p in rows.randomSplit([0.5, 0.5], 3)]
    compared = models.compare(parts[0], parts[1], ["amt", "t"], "y")
    assert compared.count() == 3


def test_component_size_in_as_many_steps_whatever_the_rows_of_a_segment(spark):
    import os

    from chronolith.operators import graph
    from chronolith.spec import Roles
    from chronolith.storage import shared_dir

    folder = f"{shared_dir(spark).removeprefix('file:')}/chronolith"
    os.makedirs(folder, exist_ok=True)
    # the path grows at one end, then at the other; keys come back later
    links = [(f"k{i}", f"x{i}") for i in range(30)] + [(f"k{i + 1}", f"x{i}") for i in range(28, -1, -1)] + [(f"k{i}", None) for i in range(0, 30, 7)]
    df = spark.createDataFrame([(i, k, i, x) for i, (k, x) in enumerate(links)], "id long, key string, t long, x string")
    steps, found = [], []
    for n in (7, 1000):
        before = set(os.listdir(folder))
        found.append({r["id"]: r["component_size"] for r in graph.component_size(df, Roles("key", "t", "id", "amt", "y"), ["x"], segment_rows=n).collect()})
        steps.append(len(set(os.listdir(folder)) - before))
    want, parts = {}, {}
    for i, (k, x) in enumerate(links):
        want[i] = len(parts.get(k, {k}))
        whole = set().union(*[parts.get(n, {n}) for n in (k, x) if n])
        parts |= dict.fromkeys(whole, whole)
    assert found == [want, want] and steps[0] == steps[1]
