"""Selected quantiles against Spark's percentile and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import quantiles

MARKS = [0.0, 0.01, 0.25, 0.5, 0.7, 0.99, 1.0]


def _columns(rng, n):
    values = {
        "normal": rng.normal(size=n), "tied": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.25), "near": 1e9 + rng.random(n) * 1e-3,
        "skewed": np.exp(rng.normal(0, 40, n)) * rng.choice([-1, 1], n), "odd": rng.choice([0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 1e308], n),
        "hot": np.where(rng.random(n) < 0.7, 3.5, rng.random(n)), "gaps": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)),
    }
    return values


@pytest.mark.parametrize("n,few", [(5000, 20_000), (5000, 0), (1, 20_000), (2, 0)])
def test_quantiles_equal_percentile(spark, monkeypatch, n, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    values = _columns(np.random.default_rng(n), n)
    rows = [tuple(None if c == "gaps" and v[k] != v[k] else float(v[k]) for c, v in values.items()) for k in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in values)).repartition(5).withColumn("void", F.lit(None).cast("double")).withColumn("a.b", F.col("tied").cast("int"))
    names = [*values, "void", "a.b"]
    got = quantiles.exact_quantiles(df, names, MARKS)
    want = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double") + 0.0, F.array(*[F.lit(m) for m in MARKS])).alias(c) for c in names]).first()
    for c in names:
        if want[c] is None:
            assert got[c] is None
        else:
            assert [repr(x + 0.0) for x in got[c]] == [repr(x + 0.0) for x in want[c]], c
    assert quantiles.exact_quantiles(df.limit(0), names, MARKS) == {c: None for c in names}


def test_nan_is_the_greatest_number(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    low, mid, high = quantiles.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])["x"]
    assert (low, mid) == (1.0, float("inf")) and high != high


def test_no_task_holds_a_column(spark):
    # half a million different values: what is shuffled are counts of prefixes, then those of the wanted buckets
    df = spark.range(500_000).select((F.col("id") * 1.000001 + 1e6).alias("x"))
    first = quantiles._counted(df, ["x"], None, 0, quantiles.BITS)
    assert first.count() < 70
    got = quantiles.exact_quantiles(df, ["x"], [0.5])["x"]
    assert got == [df.agg(F.percentile("x", 0.5)).first()[0]]


def test_distinct_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, None, None)], "x int, y string, z double")
    assert quantiles.distinct_counts(df, ["x", "y", "z"]) == {"x": 2, "y": 2, "z": 0}
