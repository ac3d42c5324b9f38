"""Ranking metrics that hold under ties, probability metrics, and cost searches.

All ranking metrics start from one row per distinct score with running class
counts.  The running sums are taken over score ranges in parallel: a window
inside each of a fixed number of ranges, plus the totals of the ranges above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def score_counts(df: DataFrame, score: str, target: str) -> DataFrame:
    """Per distinct score: positives and negatives, and running counts from the highest score down."""
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    y = F.col(target).cast("long")
    by = known.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # scores are probabilities: equal ranges of [0, 1], what lies outside in the end ranges
    part = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("score") * RANGES))).cast("int")
    parted = by.withColumn("part", part)
    sizes = parted.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    above = Window.orderBy(F.desc("part"))  # RANGES rows at most
    before = sizes.select("part", (F.sum("p").over(above) - F.col("p")).alias("p0"), (F.sum("n").over(above) - F.col("n")).alias("n0"))
    local = Window.partitionBy("part").orderBy(F.desc("score"))
    summed = parted.withColumn("cp", F.sum("pos").over(local)).withColumn("cn", F.sum("neg").over(local))
    totals = sizes.agg(F.sum("p").alias("all_pos"), F.sum("n").alias("all_neg"))
    return summed.join(F.broadcast(before), "part").crossJoin(F.broadcast(totals)).select("score", "pos", "neg", (F.col("cp") + F.col("p0")).alias("cum_pos"), (F.col("cn") + F.col("n0")).alias("cum_neg"), "all_pos", "all_neg")


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """``auc``: the share of (positive, negative) pairs in the right order, ties counting half; null without both classes."""
    rows = score_counts(df, score, target)
    beaten = F.col("pos") * (F.col("all_neg") - F.col("cum_neg") + F.col("neg") / 2)
    return rows.agg(F.try_divide(F.sum(beaten), (F.max("all_pos") * F.max("all_neg")).cast("double")).alias("auc"))


def average_precision(df: DataFrame, score: str, target: str) -> DataFrame:
    """``ap``: precision at each distinct score weighted by the gain in recall."""
    rows = score_counts(df, score, target)
    part = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return rows.agg(F.try_divide(F.sum(part), F.max("all_pos").cast("double")).alias("ap"))


def kolmogorov_smirnov(df: DataFrame, score: str, target: str) -> DataFrame:
    """``ks``: the largest gap between the classes' cumulative shares."""
    rows = score_counts(df, score, target)
    return rows.agg(F.max(F.abs(F.try_divide(F.col("cum_pos"), F.col("all_pos")) - F.try_divide(F.col("cum_neg"), F.col("all_neg")))).alias("ks"))


def confusion(df: DataFrame, predicted: Column, target: str) -> DataFrame:
    """``tp, fp, fn, tn`` and precision, recall and F1 (0 where undefined)."""
    y, p = F.col(target) == 1, predicted
    counts = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("tp", p & y), ("fp", p & ~y), ("fn", ~p & y), ("tn", ~p & ~y))])
    precision, recall = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(o)), F.lit(0.0)) for o in ("fp", "fn"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``pos, neg, pos_weight``: negatives for each positive."""
    y = F.col(target).cast("long")
    counts = df.where(F.col(target).isNotNull()).agg(F.coalesce(F.sum(y), F.lit(0)).alias("pos"), F.coalesce(F.sum(1 - y), F.lit(0)).alias("neg"))
    return counts.select("*", (F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).alias("pos_weight"))


def probability_metrics(df: DataFrame, score: str, target: str, clip: float = 1e-15) -> DataFrame:
    """``brier, logloss``."""
    y, p = F.col(target).cast("double"), F.col(score)
    safe = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return df.agg(F.avg((p - y) * (p - y)).alias("brier"), (-F.avg(y * F.ln(safe) + (1 - y) * F.ln(1 - safe))).alias("logloss"))


def reliability(df: DataFrame, score: str, target: str, n_bins: int = 10) -> DataFrame:
    """Per uniform bin: count, mean score, share of positives."""
    bin_number = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(bin_number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("share"))


def calibration_error(df: DataFrame, score: str, target: str, n_bins: int = 10) -> DataFrame:
    """``ece``: the mean gap between score and outcome, weighted by bin size."""
    bins = reliability(df, score, target, n_bins)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("share"))) / F.sum("n")).alias("ece"))


def precision_at(df: DataFrame, score: str, target: str, id: str, share: float = 0.05) -> DataFrame:
    """``n_top, precision``: the mean outcome of the ``max(1, int(n * share))`` highest scores, ties by id.

    The cut is found in the score counts; only rows of the one tied score at the
    cut are ordered.
    """
    rows = score_counts(df, score, target)
    ranked = rows.withColumn("upto", F.col("cum_pos") + F.col("cum_neg")).withColumn("n_top", F.greatest(F.lit(1), F.floor((F.col("all_pos") + F.col("all_neg")) * share)))
    at = ranked.where("upto >= n_top").orderBy(F.desc("score")).limit(1).select(F.col("score").alias("cut"), "n_top", (F.col("cum_pos") - F.col("pos")).alias("sure"), (F.col("upto") - F.col("pos") - F.col("neg")).alias("above"))
    tied = df.join(F.broadcast(at), F.col(score).cast("double") == F.col("cut"))
    chosen = tied.select(F.col(target).cast("long").alias("y"), "n_top", "sure", "above", F.row_number().over(Window.partitionBy("cut").orderBy(id)).alias("k")).where(F.col("k") <= F.col("n_top") - F.col("above"))
    return chosen.agg(F.max("n_top").alias("n_top"), ((F.sum("y") + F.max("sure")) / F.max("n_top")).alias("precision"))


def _grid_counts(df: DataFrame, score: str, target: str, grid: DataFrame) -> DataFrame:
    """Per threshold of ``grid`` (k, t): positives and negatives with a score of at least t.

    Each row looks up how many thresholds it reaches; counts of at most ``len(grid)``
    rows are then summed from the top.
    """
    reached = grid.agg(F.sort_array(F.collect_list("t")).alias("ts"))
    y = F.col(target).cast("long")
    level = F.size(F.filter("ts", lambda t: t <= F.col(score)))
    by = df.crossJoin(F.broadcast(reached)).groupBy(level.alias("level")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    every = grid.select("k", "t").join(by, grid["k"] + 1 == by["level"], "left")
    down = Window.orderBy(F.desc("k"))
    totals = by.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return every.select("k", "t", F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("fp")).crossJoin(F.broadcast(totals))


def threshold_grid(df: DataFrame, low: float = 0.01, high: float = 0.99, steps: int = 99) -> DataFrame:
    """``(k, t)``: evenly spaced thresholds."""
    step = (high - low) / max(1, steps - 1)
    return df.sparkSession.createDataFrame([(k, round(low + k * step, 10)) for k in range(steps)], "k int, t double")


def threshold_costs(df: DataFrame, score: str, target: str, cost_fp: float = 10.0, cost_fn: float = 500.0, low: float = 0.01, high: float = 0.99, steps: int = 99) -> DataFrame:
    """The cost curve: ``threshold, tp, fp, fn, cost, precision, recall``."""
    rows = _grid_counts(df, score, target, threshold_grid(df, low, high, steps))
    fn = F.col("all_pos") - F.col("tp")
    return rows.select(F.col("t").alias("threshold"), "tp", "fp", fn.alias("fn"), (F.col("fp") * cost_fp + fn * cost_fn).alias("cost"), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("all_pos")), F.lit(0.0)).alias("recall"))


def best_threshold(df: DataFrame, score: str, target: str, **costs) -> DataFrame:
    """The cheapest row of the cost curve; of equal costs the lowest threshold."""
    return threshold_costs(df, score, target, **costs).orderBy("cost", "threshold").limit(1)


def tier_costs(df: DataFrame, score: str, target: str, cost_fp: float = 10.0, cost_fn: float = 500.0, low: float = 0.01, high: float = 0.99, steps: int = 50) -> DataFrame:
    """``(low, high, cost)`` for each pair of tier thresholds; as documented, only the high one enters the cost."""
    rows = _grid_counts(df, score, target, threshold_grid(df, low, high, steps))
    # "high" is strictly above the threshold: rows equal to it are not
    at = df.where(F.col(target).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(target).cast("long")).alias("p"), F.sum(1 - F.col(target).cast("long")).alias("n"))
    equal = rows.select("t").join(at, F.col("t") == F.col("s")).select(F.col("t").alias("te"), "p", "n")
    exact = rows.join(equal, F.col("t") == F.col("te"), "left").select("t", (F.col("tp") - F.coalesce("p", F.lit(0))).alias("tp"), (F.col("fp") - F.coalesce("n", F.lit(0))).alias("fp"), "all_pos")
    cost = F.col("fp") * cost_fp + (F.col("all_pos") - F.col("tp")) * cost_fn
    lows = threshold_grid(df, low, high, steps).select(F.col("t").alias("low"))
    return exact.select(F.col("t").alias("high"), cost.alias("cost")).join(F.broadcast(lows), F.col("low") < F.col("high")).select("low", "high", "cost")


def best_tiers(df: DataFrame, score: str, target: str, **costs) -> DataFrame:
    return tier_costs(df, score, target, **costs).orderBy("cost", "low", "high").limit(1)


def assign_tiers(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """``risk_level, action, confidence`` of each row."""
    p = F.col(score)
    tier = lambda a, b, c: F.when(p < low, a).when(p > high, c).otherwise(b)
    return df.select("*", tier(F.lit("low"), F.lit("medium"), F.lit("high")).alias("risk_level"), tier(F.lit("auto_pass"), F.lit("manual_review"), F.lit("auto_block")).alias("action"), tier(1 - p, 1 - 2 * F.abs(p - 0.5), p).alias("confidence"))


def evaluate_tiers(df: DataFrame, score: str, target: str, low: float, high: float, cost_fp: float = 10.0, cost_fn: float = 500.0) -> DataFrame:
    """Rows of each tier, costs, precision and recall of the high tier."""
    p, y = F.col(score), F.col(target) == 1
    top = p > high
    row = df.agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("n_low", p < low), ("n_medium", (p >= low) & (p <= high)), ("n_high", top), ("tp", top & y), ("fp", top & ~y), ("fn", ~top & y))])
    return row.select("*", (F.col("fp") * cost_fp + F.col("fn") * cost_fn).alias("cost"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).alias("recall"))
