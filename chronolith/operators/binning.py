"""Bins, weight of evidence, information value, population stability, chi-merge."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.quantiles import exact_quantiles


def quantile_edges(df: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Distinct equal-frequency edges of each feature, from the least to the greatest value; a few numbers to the driver."""
    marks = exact_quantiles(df, features, [k / n_bins for k in range(n_bins + 1)])
    return {c: sorted(set(marks[c] or [])) for c in features}


def width_edges(df: DataFrame, features: Sequence[str], n_bins: int) -> dict[str, list[float]]:
    """Edges of ``n_bins`` bins of equal width; around a single value they span a thousandth of it to each side."""
    ends = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in features], *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in features]).first() if features else None
    out: dict[str, list[float]] = {}
    for c in features:
        low, high = ends[f"lo_{c}"], ends[f"hi_{c}"]
        if low is None:
            out[c] = []
            continue
        if low == high:
            off = 0.001 * abs(low) if low else 0.001
            low, high = low - off, high + off
        out[c] = [low + (high - low) * k / n_bins for k in range(n_bins)] + [high]
    return out


def bin_of(value: Column, edges: Sequence[float], right: bool = True) -> Column:
    """The number of the bin, from 0: ``(l, r]`` with the first closed, or ``[l, r)`` with the last closed; null outside."""
    n = len(edges) - 1
    out = F.lit(None).cast("int")
    for k in reversed(range(n)):
        low, high = F.lit(float(edges[k])), F.lit(float(edges[k + 1]))
        if right:
            inside = ((value > low) if k else (value >= low)) & (value <= high)
        else:
            inside = (value >= low) & ((value < high) if k < n - 1 else (value <= high))
        out = F.when(inside, k).otherwise(out)
    return out


def long_form(df: DataFrame, edges: dict[str, Sequence[float]], keep: Sequence[str], right: bool = True) -> DataFrame:
    """``(feature, bin, *keep)`` of every row and feature with a value: one scan for all features."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), bin_of(F.col(c).cast("double"), e, right).alias("bin")) for c, e in edges.items()]
    return df.select(*keep, F.explode(F.array(*cells)).alias("cell")).select("cell.feature", "cell.bin", "cell.value", *keep).where("value is not null")


def woe_table(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10, bins: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """Counts, shares, weight of evidence and IV part of each bin; empty bins count as a share of 1e-10."""
    known = df.where(F.col(target).isNotNull())
    edges = {c: list(e) for c, e in (bins or quantile_edges(known, features, n_bins)).items()}
    # quantiles that all fall together give no bin: those features are cut in equal widths
    edges |= width_edges(known, [c for c, e in edges.items() if len(e) == 1], n_bins)
    edges = {c: e for c, e in edges.items() if e}
    spark = df.sparkSession
    if not edges:
        return spark.createDataFrame([], "feature string, bin int, count long, bad long, good long, bad_rate double, good_pct double, bad_pct double, woe double, iv_component double")
    rows = long_form(df.where(F.col(target).isNotNull()), edges, [target])
    y = F.col(target).cast("long")
    by = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"), F.sum(y).alias("bad"))
    totals = by.groupBy("feature").agg(F.sum("count").alias("all"), F.sum("bad").alias("all_bad"))
    every = spark.createDataFrame([(c, k) for c, e in edges.items() for k in range(len(e) - 1)], "feature string, bin int")
    full = every.join(by, ["feature", "bin"], "left").join(totals, "feature")
    count, bad = F.coalesce("count", F.lit(0)), F.coalesce("bad", F.lit(0))
    good = count - bad
    tiny = F.lit(1e-10)
    good_pct, bad_pct = F.try_divide(good, F.col("all") - F.col("all_bad")), F.try_divide(bad, F.col("all_bad"))
    g, b = (F.when(F.coalesce(x, F.lit(0.0)) == 0, tiny).otherwise(x) for x in (good_pct, bad_pct))
    woe = F.ln(b / g)
    return full.select("feature", "bin", count.alias("count"), bad.alias("bad"), good.alias("good"), F.coalesce(F.try_divide(bad, count), F.lit(0.0)).alias("bad_rate"), g.alias("good_pct"), b.alias("bad_pct"), woe.alias("woe"), ((b - g) * woe).alias("iv_component"))


def information_values(df: DataFrame, features: Sequence[str], target: str, n_bins: int = 10, useful: float = 0.02) -> DataFrame:
    """``(feature, iv, useful)`` of all features from one pass, rounded to 6 digits."""
    table = woe_table(df, features, target, n_bins)
    named = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    iv = F.round(F.coalesce("iv", F.lit(0.0)), 6)
    return named.join(table.groupBy("feature").agg(F.sum("iv_component").alias("iv")), "feature", "left").select("feature", iv.alias("iv"), (iv >= useful).alias("useful")).orderBy(F.desc("iv"), "feature")


def stability(expected: DataFrame, actual: DataFrame, features: Sequence[str], n_bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """``(feature, psi, drifted)``: edges from ``expected``; values outside are left out; empty shares count as 1e-4."""
    present = [c for c in features if c in expected.columns and c in actual.columns]
    named = expected.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    edges = {c: e for c, e in quantile_edges(expected, present, n_bins).items() if len(e) > 1} if present else {}
    if not edges:
        return named.select("feature", F.lit(0.0).alias("psi"), F.lit(False).alias("drifted"))
    sides = []
    for name, df in (("e", expected), ("a", actual)):
        by = long_form(df, edges, [], right=False).where("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
        sides.append(by.withColumn("side", F.lit(name)))
    both = sides[0].unionByName(sides[1]).groupBy("feature", "bin").agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s) for s in ("e", "a")])
    every = expected.sparkSession.createDataFrame([(c, k) for c, e in edges.items() for k in range(len(e) - 1)], "feature string, bin int")
    totals = both.groupBy("feature").agg(F.sum("e").alias("all_e"), F.sum("a").alias("all_a"))
    full = every.join(both, ["feature", "bin"], "left").join(totals, "feature").where("all_e > 0 and all_a > 0")
    share = lambda s: F.when(F.coalesce(s, F.lit(0)) == 0, 1e-4).otherwise(F.col(s) / F.col(f"all_{s}"))
    psi = full.select("feature", ((share("e") - share("a")) * F.ln(share("e") / share("a"))).alias("part")).groupBy("feature").agg(F.sum("part").alias("psi"))
    found = F.coalesce("psi", F.lit(0.0))
    return named.join(psi, "feature", "left").select("feature", found.alias("psi"), (found > threshold).alias("drifted"))


def chi_square(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Of two bins (good, bad); infinite where a row or column of the table is empty."""
    n = sum(a) + sum(b)
    product = sum(a) * sum(b) * (a[0] + b[0]) * (a[1] + b[1])
    return n * (a[0] * b[1] - a[1] * b[0]) ** 2 / product if product else math.inf


def chi_merge(df: DataFrame, feature: str, target: str, max_bins: int = 5, min_share: float = 0.05, first_bins: int = 50) -> list[float]:
    """Edges from -inf to inf: adjacent quantile bins are merged while their classes differ least.

    The rows are reduced to at most ``first_bins`` counts; those few are merged on the driver.
    """
    known = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    edges = quantile_edges(known, [feature], first_bins)[feature]
    if len(edges) < 2:
        return [-math.inf, math.inf]
    y = F.col(target).cast("long")
    counted = known.groupBy(bin_of(F.col(feature).cast("double"), edges).alias("bin")).agg(F.sum(1 - y).alias("good"), F.sum(y).alias("bad")).orderBy("bin").collect()
    bins = [[edges[r["bin"]], (r["good"], r["bad"])] for r in counted]
    total = sum(sum(c) for _, c in bins)

    def merge(k: int) -> None:
        bins[k][1] = (bins[k][1][0] + bins[k + 1][1][0], bins[k][1][1] + bins[k + 1][1][1])
        del bins[k + 1]

    while len(bins) > max_bins:
        scores = [chi_square(bins[k][1], bins[k + 1][1]) for k in range(len(bins) - 1)]
        finite = [s for s in scores if s < math.inf]
        merge(scores.index(min(finite)) if finite else min(range(len(scores)), key=lambda k: sum(bins[k][1]) + sum(bins[k + 1][1])))
    while len(bins) > 1 and (small := next((k for k, (_, c) in enumerate(bins) if sum(c) < min_share * total), None)) is not None:
        left = small and (small == len(bins) - 1 or sum(bins[small - 1][1]) <= sum(bins[small + 1][1]))
        merge(small - 1 if left else small)
    return [-math.inf, *[e for e, _ in bins[1:]], math.inf]
