"""Windows over earlier rows: worked examples, ties, and the leakage test by mutation."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chronolith.operators import history
from chronolith.spec import Roles

ROLES = Roles()


def frame(spark, rows, keys=None):
    return spark.createDataFrame([(k + 1, (keys or ["A"] * len(rows))[k], t, float(a)) for k, (t, a) in enumerate(rows)], "id long, key string, t long, amt double")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_history_basic(spark):
    df = frame(spark, [(1000, 10), (2000, 20), (3000, 30), (1500, 5), (2500, 15)], ["A", "A", "A", "B", "B"])
    out = history.history_features(df, ROLES, [3600])
    assert column(out, "time_since_last") == [0, 1000, 1000, 0, 1000]
    assert column(out, "tx_count_last_3600s") == [0, 1, 2, 0, 1]
    assert column(out, "cumulative_spend") == [0, 10, 30, 0, 5]


@pytest.mark.parametrize("times, width, want", [([0, 1000, 2000, 3500], 3600, [0, 1, 2, 3]), ([0, 2000, 5000], 3000, [0, 1, 1]), ([0, 1000, 1000, 4600], 3600, [0, 1, 2, 2])])
def test_window_counts(spark, times, width, want):
    out = history.history_features(frame(spark, [(t, 1) for t in times]), ROLES, [width], ["count"])
    assert column(out, f"tx_count_last_{width}s") == want


def test_two_windows_and_mean(spark):
    df = frame(spark, [(0, 10), (500, 20), (1500, 30), (3000, 40), (5000, 50)])
    out = history.history_features(df, ROLES, [1000, 3000])
    assert column(out, "tx_count_last_1000s")[:3] == [0, 1, 1] and column(out, "amt_sum_last_1000s")[:3] == [0, 10, 20] and column(out, "amt_mean_last_1000s")[1] == 10
    assert column(out, "tx_count_last_3000s")[3] == 3 and column(out, "amt_sum_last_3000s")[3] == 60


def test_window_deviation_min_max(spark):
    out = history.history_features(frame(spark, [(0, 10), (1000, 10), (2000, 30), (3000, 30)]), ROLES, [3600], ["std", "min", "max"])
    assert column(out, "amt_std_last_3600s")[:3] == [0, 0, 0] and math.isclose(column(out, "amt_std_last_3600s")[3], 9.428, abs_tol=1e-3)
    assert column(out, "amt_min_last_3600s") == [0, 10, 10, 10] and column(out, "amt_max_last_3600s") == [0, 10, 10, 30]
    with pytest.raises(ValueError):
        history.history_features(frame(spark, [(0, 1)]), ROLES, [1], ["median"])


def test_prior_aggregates(spark):
    df = frame(spark, [(3600, 10), (43200, 20), (75600, 30), (86400, 5), (90000, 15)], ["A", "A", "A", "B", "B"]).withColumn("addr", F.element_at(F.array(*[F.lit(x) for x in (1, 1, 2, 3, 3)]), F.col("id").cast("int")))
    out = history.prior_aggregates(df, ROLES, [["key"], ["key", "addr"]])
    assert column(out, "key_amt_count") == [0, 1, 2, 0, 1] and column(out, "key_amt_sum") == [0, 10, 30, 0, 5] and column(out, "key_amt_mean") == [0, 10, 15, 0, 5]
    assert column(out, "key+addr_amt_count") == [0, 1, 0, 0, 1]
    assert math.isclose(column(out, "key_amt_std")[2], math.sqrt(50))


def test_chunked_sums_equal_the_window(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 9 != 0, F.lit("hot")).alias("key"), (F.col("id") * 37 % 1000).alias("t"), (F.col("id") % 13).cast("double").alias("amt"))
    one = history.prior_aggregates(df, ROLES, [["key"]], stats=["count", "sum"])
    two = history.prior_sums_in_chunks(df, ROLES, 100)
    assert column(one, "key_amt_count") == column(two, "prior_count") and column(one, "key_amt_sum") == column(two, "prior_sum")


def test_amount_and_velocity(spark):
    df = frame(spark, [(0, 10.5), (1000, 20), (0, 5)], ["A", "A", "B"])
    out = history.amount_features(df, ROLES)
    assert column(out, "amount_delta") == [0, 9.5, 0] and column(out, "is_first_trx") == [1, 0, 1] and column(out, "is_integer_amount") == [0, 1, 1]
    assert math.isclose(column(out, "amount_ratio")[1], 20 / 10.5) and column(out, "amount_ratio")[0] == 1
    fast = history.velocity_features(frame(spark, [(0, 0), (1000, 20), (1500, 10)]), ROLES)
    assert column(fast, "velocity") == [0, 0.02, -0.02] and column(fast, "acceleration")[0] == 0
    still = history.velocity_features(frame(spark, [(5, 0), (5, 10)]), ROLES)
    assert column(still, "velocity") == [0, 0] and column(still, "acceleration") == [0, 0]


def test_rows_without_a_key_have_no_history(spark):
    df = spark.createDataFrame([(1, None, 1, 5.0), (2, None, 2, 6.0)], "id long, key string, t long, amt double")
    out = history.history_features(df, ROLES, [10])
    assert column(out, "tx_count_last_10s") == [0, 0] and column(out, "cumulative_spend") == [0, 0]


def test_later_amounts_do_not_leak(spark):
    rows = [(0, 10), (500, 20), (500, 25), (1500, 30)]

    def earlier(last):
        df = frame(spark, [*rows[:-1], (1500, last)])
        out = history.amount_features(history.prior_aggregates(history.history_features(df, ROLES, [1000], ["count", "sum", "mean", "std"]), ROLES, [["key"]]), ROLES)
        return [tuple(r) for r in out.orderBy("id").collect()][:-1]

    assert earlier(30) == earlier(999999)


def test_chunked_history_is_the_plain_one(spark):
    rows = [(k, None if k % 17 == 0 else k % 2, (k * 7) % 90 if k % 3 else 50, None if k % 5 == 0 else float((k * 31) % 40) + 1e6) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, key long, t long, amt double").withColumn("extra", F.lit("x"))
    plain = {r["id"]: r for r in history.prior_aggregates(df, ROLES, [["key"]], stats=history.STATS).collect()}
    chunked = history.prior_in_chunks(df, ROLES, 20).collect()
    assert len(chunked) == 200
    for r in chunked:
        for stat in history.STATS:
            assert abs(r[f"key_amt_{stat}"] - plain[r["id"]][f"key_amt_{stat}"]) < 1e-4, (r["id"], stat)
    whole = {r["id"]: r for r in history.history_features(df, ROLES, [25], history.STATS).collect()}
    for r in history.history_in_chunks(df, ROLES, 25, history.STATS).collect():
        for name in ("tx_count_last_25s", *[f"amt_{s}_last_25s" for s in ("sum", "mean", "std", "min", "max")]):
            assert abs(r[name] - whole[r["id"]][name]) < 1e-3, (r["id"], name)
    assert history.prior_in_chunks(df.limit(0), ROLES, 20).count() == 0
