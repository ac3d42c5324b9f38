"""Keys too hot for one task give what the plain windows give."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import history, hot
from chronolith.spec import Roles

ROLES = Roles()
STATS = ["count", "sum", "mean", "std", "min", "max"]


@pytest.fixture(scope="module")
def df(spark):
    """One key with half of the rows, two that are warm, 300 others; ties on time, nulls, large amounts."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(2400):
        key = 1 if k % 2 else int(rng.integers(2, 4)) if k % 8 == 0 else int(rng.integers(10, 300))
        rows.append((k, None if k % 97 == 0 else key, int(key % 2), int(rng.integers(0, 400)), None if k % 13 == 0 else 1e6 + float(rng.integers(0, 900)) / 8))
    return spark.createDataFrame(rows, "id long, key long, other long, t long, amt double").repartition(3)


MADE = {
    "history": lambda d: history.history_features(d, ROLES, [30, 200], STATS, ["amt"]),
    "prior": lambda d: history.prior_aggregates(d, ROLES, [["key"], ["key", "other"], ["other"], ["absent"]], ["amt"], STATS, "_x"),
    "amount": lambda d: history.amount_features(d, ROLES),
    "velocity": lambda d: history.velocity_features(d, ROLES),
}


@pytest.mark.parametrize("name", MADE)
def test_hot_keys_are_cut_and_give_the_same(df, monkeypatch, name):
    monkeypatch.setattr(hot, "HOT", 10**9)
    plain = MADE[name](df)
    want = {r["id"]: r.asDict() for r in plain.collect()}
    monkeypatch.setattr(hot, "HOT", 200)
    cut = []
    own = hot.segmented
    monkeypatch.setattr(hot, "segmented", lambda *a: (cut.append(a[0].count()), own(*a))[1])
    for size in (1, 50):
        monkeypatch.setattr(hot, "SEGMENT", size)
        found = MADE[name](df)
        assert found.dtypes == plain.dtypes
        got = {r["id"]: r.asDict() for r in found.collect()}
        assert got.keys() == want.keys() and len(got) == 2400
        for k, w in want.items():
            for c, v in w.items():
                assert got[k][c] == v or got[k][c] == pytest.approx(v, rel=1e-7, abs=1e-7), (name, size, k, c, got[k][c], v)
    assert cut and min(cut) < 2400


def test_no_join_is_on_the_hot_key_alone(df, monkeypatch):
    monkeypatch.setattr(hot, "HOT", 200)
    monkeypatch.setattr(hot, "SEGMENT", 50)
    rows = hot.segmented(df.where("key = 1"), ["key"], "t", "id")
    assert rows.groupBy("_seg").count().agg(F.max("count")).first()[0] == 50
    met, _ = hot.expanding(rows, ["key"], "t", "id", "amt")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert all("_seg" in line for line in plan.splitlines() if "Join " in line) and "Join " in plan


def test_component_sizes_of_rows_that_repeat_an_id(spark):
    from chronolith.operators import graph

    df = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 1, "x"), (1, "b", 1, "x"), (2, "c", 2, None)], "id long, key string, t long, mail string")
    got = sorted((r["t"], r["component_size"]) for r in graph.component_size(df, ROLES, ["mail"]).collect())
    assert [t for t, _ in got] == [0, 1, 1, 2] and got[0] == (0, 1) and got[3] == (2, 1) and sorted(s for t, s in got if t == 1) == [1, 3]


def test_components_of_hubs(spark):
    from chronolith.operators.components import _beside_least, connected_components

    # two stars of many leaves, joined by a path that only their leaves touch; a ring, and a node that is its own
    rng = np.random.default_rng(1)
    edges = [(5, 1000 + k) for k in range(6000)] + [(7, 100_000 + k) for k in range(5000)] + [(1003, 500), (500, 499), (499, 100_777)]
    edges += [(200_000 + k, 200_000 + (k + 1) % 50) for k in range(50)] + [(3, 3), (None, 4)]
    rng.shuffle(edges)
    df = spark.createDataFrame([(None if a is None else int(a), int(b)) for a, b in edges], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    want = {5: 5, 7: 5, 500: 5, 499: 5} | {1000 + k: 5 for k in range(6000)} | {100_000 + k: 5 for k in range(5000)} | {200_000 + k: 200_000 for k in range(50)}
    assert got == want
    # no key of the shuffle join has more than the bound
    pairs = df.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    met = _beside_least(pairs, 1000)
    assert met.count() == pairs.count() and met.where("u = 5 and m <> 1000").count() == 0
    assert "BroadcastHashJoin" in met._jdf.queryExecution().executedPlan().toString()
