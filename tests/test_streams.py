"""Streams in the order of event time against the same rows as a batch."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import history, recurrent, sequence
from chronolith.operators.rules import Amount, Blacklist, RuleEngine, Velocity
from chronolith.plans import training
from chronolith.plans.features import FeaturePlan, configure
from chronolith.spec import Roles
from chronolith.streaming import folds, ordered, scoring, stateful

ROLES = Roles()
SCHEMA = "id long, key long, t long, amt double, card string, gone boolean"
END = 10**8


@pytest.fixture(scope="module")
def shuffled():
    """Events whose order of arrival is up to 400 ticks off, in files; times tie; amounts have nulls; then the end of the stream."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(240):
        t = int(rng.integers(0, 300)) * 10
        rows.append((k, int(rng.integers(0, 5)), t, None if k % 17 == 0 else float(rng.integers(1, 2000)) / 8, "bad" if k % 23 == 0 else "good", False))
    rows.append((900, None, 50, 1.0, "good", False))
    arrival = sorted(rows, key=lambda r: r[2] + rng.integers(0, 400))
    return [arrival[i : i + 80] for i in range(0, len(arrival), 80)] + [[(999, 0, END, None, None, True)]]


@pytest.fixture
def stream(spark, shuffled, tmp_path):
    for k, part in enumerate(shuffled):
        path = tmp_path / "in" / f"b{k}"
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(path))
        for f in path.iterdir():
            os.utime(f, (k + 1, k + 1))
    return stateful.read_events(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, 1)


def _batch(spark, shuffled):
    return spark.createDataFrame([r for part in shuffled[:-1] for r in part], SCHEMA).where("key is not null")


def _run(frame, tmp_path, name="out"):
    frame.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start().awaitTermination()
    return {r["id"]: r.asDict() for r in frame.sparkSession.read.schema(frame.schema).parquet(str(tmp_path / name)).collect()}


def _same(a, b, columns):
    assert a.keys() == b.keys() and len(a) > 200
    for k in a:
        for c in columns:
            x, y = a[k][c], b[k][c]
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-9, abs=1e-9)), (k, c, x, y)


def test_late_events_count_where_they_belong(spark, shuffled, stream, tmp_path):
    got = _run(stateful.velocity_counts(stream, ROLES, 300, late="400 seconds", reset="gone"), tmp_path)
    want = {r["id"]: r.asDict() for r in Velocity(300, 5).apply(_batch(spark, shuffled), ROLES)[0].collect()}
    assert {k: v["n_recent"] for k, v in got.items()} == {k: v["_recent"] for k, v in want.items()}
    # times were out of order, or this would show nothing
    assert [r[2] for p in shuffled for r in p] != sorted(r[2] for p in shuffled for r in p)


def test_states_end_and_are_reset_at_their_place_in_time(spark, tmp_path):
    rows = [[(1, 1, 100, 1.0, "", False), (2, 1, 150, 1.0, "", False), (3, 2, 150, 1.0, "", False)], [(5, 2, 160, 1.0, "", False), (4, 2, 155, None, "", True)], [(6, 3, 90_000, 1.0, "", False)], [(7, 3, 200_000, 1.0, "", False)]]
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        for f in (tmp_path / "in" / f"b{k}").iterdir():
            os.utime(f, (k + 1, k + 1))
    source = stateful.read_events(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, 1)
    got = _run(stateful.velocity_counts(source, ROLES, 300, late="1 minute", reset="gone"), tmp_path)
    assert {k: v["n_recent"] for k, v in got.items()} == {1: 1, 2: 2, 3: 1, 5: 1, 6: 1}
    held = {r["key"][0]: json.loads(r["value"][0]) for r in stateful.read_state(spark, str(tmp_path / "out-cp")).collect()}
    waiting = [r["key"][0] for r in stateful.read_state(spark, str(tmp_path / "out-cp"), "waiting").collect()]
    # the far later events of key 3 let the states of keys 1 and 2 end, and its last event still waits
    assert set(held) <= {3} and waiting == [3]


def test_folds_equal_the_windows(spark, shuffled, tmp_path):
    batch = _batch(spark, shuffled)
    stats = ["count", "sum", "mean", "std", "min", "max"]
    made = [folds.History(ROLES, [200, 3600], stats), folds.Aggregation(ROLES, [["key"]], stats=stats), folds.Amounts(ROLES), folds.Speeds(ROLES), folds.LastRows(["amt"], 3)]
    got = {r["id"]: r.asDict() for r in ordered.replayed(batch, ROLES, made).collect()}
    want = history.history_features(batch, ROLES, [200, 3600], stats)
    want = history.velocity_features(history.amount_features(history.prior_aggregates(want, ROLES, [["key"]], stats=stats), ROLES), ROLES)
    _same(got, {r["id"]: r.asDict() for r in want.collect()}, [n for f in made[:-1] for n in f.outputs])
    tails = {r["key"]: r["sequence"] for r in sequence.sequence_tail(batch, ROLES, ["amt"], 3).collect()}
    last = {}
    for r in sorted(got.values(), key=lambda r: (r["t"], r["id"])):
        last[r["key"]] = r["sequence"]
    assert last == tails


def test_recurrent_embeddings_of_a_stream_equal_a_replay(spark, shuffled, stream, tmp_path):
    encoder = recurrent.RecurrentEncoder(["amt", "t"], np.array([100.0, 1500.0]), np.array([0.01, 0.001]), recurrent.initial(2, 6, 3))
    again = recurrent.RecurrentEncoder.from_json(encoder.to_json())
    fold = folds.Recurrent(again)
    got = _run(ordered.in_order(stream, ROLES, [fold], "400 seconds", reset="gone"), tmp_path)
    batch = _batch(spark, shuffled)
    want = {r["id"]: r.asDict() for r in ordered.replayed(batch, ROLES, [folds.Recurrent(encoder)]).collect()}
    assert {k: (v["seq_embedding"], v["seq_anomaly"]) for k, v in got.items()} == {k: (v["seq_embedding"], v["seq_anomaly"]) for k, v in want.items()}
    # the last embedding is what the encoder gives for the whole sequence
    whole = {r["key"]: r for r in encoder.transform(batch, ROLES, 100).collect()}
    last = {}
    for r in sorted(got.values(), key=lambda r: (r["t"], r["id"])):
        last[r["key"]] = r
    assert all(np.allclose(last[k]["seq_embedding"], whole[k]["embedding"]) for k in whole) and len(whole) == 5
    # a stream that starts from states goes on where a batch ended
    early, late = batch.where("t < 1500"), batch.where("t >= 1500")
    warm = ordered.states_of(early, ROLES, [fold])
    parts = late.unionByName(spark.createDataFrame([(999, 0, END, None, None, True)], SCHEMA))
    parts.coalesce(1).write.parquet(str(tmp_path / "rest" / "b0"))
    rest = stateful.read_events(spark, str(tmp_path / "rest" / "*"), batch.schema, 1)
    continued = _run(ordered.in_order(rest, ROLES, [fold], "0 seconds", reset="gone", warm=warm), tmp_path, "warm")
    assert {k: v["seq_embedding"] for k, v in continued.items()} == {k: v["seq_embedding"] for k, v in want.items() if v["t"] >= 1500}


def test_rules_of_a_stream_equal_the_batch(spark, shuffled, stream, tmp_path):
    engine = RuleEngine([Blacklist("card", spark.createDataFrame([("bad",)], "value string")), Velocity(300, 5), Amount(220.0)])
    events = stream.where(F.col("gone") == F.lit(False)).unionByName(stream.where("gone").withColumns({"key": F.lit(-1).cast("long")}))
    got = _run(stateful.rules_in_order(events, engine, ROLES, "400 seconds"), tmp_path)
    want = {r["id"]: (r["rule"], r["rule_action"]) for r in engine.evaluate(_batch(spark, shuffled), ROLES).collect()}
    assert {k: (v["rule"], v["rule_action"]) for k, v in got.items() if k != 999} == want
    assert {w[0] for w in want.values()} == {None, "blacklist", "velocity", "amount"}


def test_scores_of_a_stream_equal_the_batch(spark, shuffled, stream, tmp_path):
    batch = _batch(spark, shuffled).withColumn("y", (F.coalesce("amt", F.lit(0.0)) > 120).cast("int"))
    steps = ["time", "amount", {"history": {"windows": [300]}}, {"history": {"windows": [900], "instance": "long"}}, "velocity", {"aggregation": {"group_keys": [["key"]]}}, {"label_encoding": {"column": "card"}}]
    trained = training.train(batch.drop("gone"), ROLES, steps, maxIter=3, maxDepth=3)
    assert scoring.streaming_steps(trained.plan) == ["amount", "history", "long", "velocity", "aggregation"]
    events = stream.withColumn("y", F.lit(None).cast("int"))
    got = _run(scoring.score_in_order(events, trained, "400 seconds", reset="gone"), tmp_path)
    want = {r["id"]: r.asDict() for r in trained.score(batch.drop("gone")).collect()}
    _same(got, want, ["probability", "risk_level", "action", "binary_prediction"])
    plan = FeaturePlan(configure(["graph_distinct"]), ROLES)
    with pytest.raises(ValueError, match="does not run on a stream"):
        scoring.plan_folds(plan)


def test_last_sequences_end_when_idle(spark, shuffled, stream, tmp_path):
    got = _run(stateful.last_sequences(stream, ROLES, ["amt"], 3, late="400 seconds", idle=1000), tmp_path)
    assert max(len(v["sequence"]) for v in got.values()) == 3 and all(v["n"] == len(v["sequence"]) for v in got.values())
    assert stateful.read_state(spark, str(tmp_path / "out-cp")).count() == 0


def test_rule_stream_reads_its_last_ticks_only(spark, tmp_path):
    rows = [(k, k % 2, k * 100, 1.0, "good", False) for k in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        for f in (tmp_path / "in" / f"b{k}").iterdir():
            os.utime(f, (k + 1, k + 1))
    source = stateful.read_events(spark, str(tmp_path / "in" / "*"), spark.createDataFrame([], SCHEMA).schema, 1)
    engine = RuleEngine([Velocity(600, 2)])
    sink = str(tmp_path / "sink")
    stateful.rule_stream(source, engine, ROLES, sink, str(tmp_path / "cp"), 600).awaitTermination()
    got = {r["id"]: r["rule"] for r in spark.read.parquet(sink).collect()}
    # a row that is challenged counts for no later one
    passed, want = {0: [], 1: []}, {}
    for i, key, t, *_ in rows:
        recent = [s for s in passed[key] if s >= t - 600]
        want[i] = "velocity" if len(recent) + 1 > 2 else None
        passed[key].append(t)
    assert got == want
    assert {p.name for p in (tmp_path / "sink").iterdir() if p.name.startswith("slot=")} == {f"slot={k}" for k in range(7)}


# --- the encoder ---


def _turning(n, length, seed):
    """Sequences whose next value is the product of the last two signs: no linear reader can tell."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, length, 1))
    x[:, :2, 0] = rng.choice([-1.0, 1.0], (n, 2))
    for t in range(2, length):
        x[:, t, 0] = x[:, t - 1, 0] * x[:, t - 2, 0]
    return x, np.full(n, length)


def test_gradients_of_the_cell():
    rng = np.random.default_rng(0)
    x, lengths, w = rng.standard_normal((5, 6, 2)), np.array([6, 3, 1, 4, 0]), recurrent.initial(2, 4, 1)
    _, g = recurrent._gradients(w, x, lengths)
    for k in recurrent.NAMES:
        at = tuple(int(rng.integers(0, s)) for s in w[k].shape)
        ends = []
        for step in (1e-5, -2e-5):
            w[k][at] += step
            ends.append(recurrent._gradients(w, x, lengths)[0])
        w[k][at] += 1e-5
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-5, abs=1e-9)


def test_recurrent_encoder_learns_what_a_linear_one_cannot():
    x, lengths = _turning(400, 12, 1)
    encoder = recurrent.fit_arrays(x, lengths, ["v"], hidden=12, epochs=150, rate=0.02, batch=100)
    held, held_lengths = _turning(200, 12, 2)
    _, errors = encoder.encode(held, held_lengths)
    z = (held - encoder.mean) * encoder.scale
    # the best linear forecast from all values before
    linear = 0.0
    for t in range(12):
        past, now = z[:, :t, 0], z[:, t, 0]
        design = np.concatenate([past, np.ones((len(z), 1))], axis=1)
        linear += float(np.mean((design @ np.linalg.lstsq(design, now, rcond=None)[0] - now) ** 2)) / 12
    # the first two values of a sequence are free, so no reader gets below 2 of 12
    assert errors.mean() - 2 / 12 < 0.1 * (linear - 2 / 12)
    again = recurrent.fit_arrays(x, lengths, ["v"], hidden=12, epochs=2, rate=0.02, batch=100)
    assert again.to_json() == recurrent.fit_arrays(x, lengths, ["v"], hidden=12, epochs=2, rate=0.02, batch=100).to_json()


def test_encoder_is_fitted_on_a_bounded_sample(spark, shuffled):
    batch = _batch(spark, shuffled)
    encoder = recurrent.fit(batch, ROLES, ["amt", "t"], length=6, sample=3, hidden=4, epochs=3)
    assert encoder.transform(batch, ROLES, 6).count() == 5
    empty = recurrent.fit(batch.limit(0), ROLES, ["amt"], epochs=1)
    assert empty.transform(batch.limit(0), ROLES).count() == 0


def test_an_entity_with_nothing_to_give_yields_no_frame():
    import pandas as pd

    from chronolith.streaming.folds import RecentCount

    class Value:
        update = registerTimer = appendList = lambda self, *_: None
        getListState = getValueState = lambda self, *_: self

    states = ordered._States([RecentCount(10)], ROLES, [ROLES.id, ROLES.key, ROLES.time], None)
    processor = ordered._InOrder(states, None, "second", None)
    processor.init(Value())
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    assert list(processor.handleInputRows((1,), iter([pd.DataFrame([(1, 1, 5)])]), clock)) == []


class _Handle:
    """Timers and states of one key in memory, and how often they were called."""

    def __init__(self):
        self.timers, self.lists, self.calls = [], {}, 0

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getListState(self, name, _):
        handle, self.lists[name] = self, []

        class State:
            def get(self):
                handle.calls += 1
                return iter(list(handle.lists[name]))

            def put(self, rows):
                handle.calls += 1
                handle.lists[name] = list(rows)

            def appendList(self, rows):
                handle.calls += 1
                handle.lists[name] += rows

            def clear(self):
                self.put([])

        return State()

    getValueState = getListState


def _clock(now):
    return type("Clock", (), {"getCurrentWatermarkInMs": lambda self: now})()


def test_entities_of_a_bucket_cost_one_call_each_and_one_frame(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ordered, "SHIFT", 0)
    rows = [(k, k % 300, k // 300) for k in range(1200)]
    states = ordered._States([folds.RecentCount(100)], ROLES, [ROLES.id, ROLES.key, ROLES.time], None)
    processor, handle = ordered._InOrder(states, None, "second", 100), _Handle()
    processor.init(handle)
    processor.handleInputRows((0,), iter([pd.DataFrame(rows)]), _clock(0))
    # times 0 and 1 are due, twice named by timers; then all
    first = [f for _ in range(2) for f in processor.handleExpiredTimer((0,), _clock(1500), None)]
    second = list(processor.handleExpiredTimer((0,), _clock(9000), None))
    assert len(first) == len(second) == 1 and handle.calls <= 14
    got = {r[0]: r[3] for f in (first[0], second[0]) for r in f.itertuples(index=False)}
    assert got == {k: k // 300 + 1 for k in range(1200)} and len(first[0]) == 600
    assert len(handle.lists["held"]) == 300 and handle.lists["waiting"] == []
    # states end, and with them their bucket's rows
    list(processor.handleExpiredTimer((0,), _clock(200_000), None))
    assert handle.lists["held"] == []


def test_large_buckets_give_frames_in_pieces(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(ordered, "SHIFT", 0)
    monkeypatch.setattr(ordered, "PIECE", 7)
    states = ordered._States([folds.RecentCount(100)], ROLES, [ROLES.id, ROLES.key, ROLES.time], None)
    processor, handle = ordered._InOrder(states, None, "second", None), _Handle()
    processor.init(handle)
    processor.handleInputRows((0,), iter([pd.DataFrame([(k, k % 5, k // 5) for k in range(50)])]), _clock(0))
    frames = list(processor.handleExpiredTimer((0,), _clock(9000), None))
    assert max(map(len, frames)) == 7 and {r[0]: r[3] for f in frames for r in f.itertuples(index=False)} == {k: k // 5 + 1 for k in range(50)}


def test_a_stream_in_one_bucket_equals_the_batch(spark, shuffled, stream, tmp_path):
    got = _run(stateful.velocity_counts(stream, ROLES, 300, late="400 seconds", reset="gone", buckets=1), tmp_path)
    want = {r["id"]: r["_recent"] for r in Velocity(300, 5).apply(_batch(spark, shuffled), ROLES)[0].collect()}
    assert {k: v["n_recent"] for k, v in got.items()} == want and len(want) == 240
    waiting = stateful.read_state(spark, str(tmp_path / "out-cp"), "waiting").collect()
    assert [(r["key"]["key"], r["list_element"]["id"]) for r in waiting] == [(0, 999)]
