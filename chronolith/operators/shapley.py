"""Exact Shapley values of tree ensembles, weighted by the rows that trained each path.

The value of a set of features is what the trees expect when only those are known:
at a split on an unknown feature both sides count by their share of training
rows (Lundberg, Erion and Lee, 2018).  A leaf is reached with a product over
the distinct features of its path: 1 or 0 for a known one, as the row meets its
conditions or not, and the product of shares ``z`` for an unknown one.  So a
leaf's part in a feature's Shapley value is a sum over the sizes of subsets of
the path's other features, read from the coefficients of a polynomial: it is
extended by each feature of the path, and each feature is unwound from it again.
That takes the square of the path's features, not two to the power of all.

The trees become a table of leaves that is sent to all tasks; its size is
checked.  Rows pass in batches, vectorised over the rows, and are not shuffled.
A null or NaN feature counts as 0, and an absent column too, as in scoring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More leaves than this are refused: the table goes to every task.
MOST_LEAVES = 1_000_000


@dataclass
class Leaf:
    """Distinct features of the path with bounds ``low < x <= high``, shares of training rows, and the weighted value."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def leaves_of(nodes: DataFrame) -> tuple[list[str], list[Leaf]]:
    """The features and leaves of a node table (:func:`chronolith.operators.models.tree_nodes`)."""
    rows = nodes.select("tree_id", "node_id", "left", "right", "feature", "threshold", "value", "n", "weight").limit(2 * MOST_LEAVES + 1).collect()
    if len(rows) > 2 * MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves")
    names = sorted({r["feature"] for r in rows if r["feature"] is not None})
    place = {c: k for k, c in enumerate(names)}
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["tree_id"], {})[r["node_id"]] = r
    out: list[Leaf] = []
    for tree in sorted(trees):
        own = trees[tree]
        stack: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = own[at]
            if node["left"] < 0:
                order = sorted(path)
                parts = [np.array([path[f][k] for f in order], float) for k in range(3)]
                out.append(Leaf(np.array(order, np.int64), *parts, float(node["value"]) * float(node["weight"])))
                continue
            f, total = place[node["feature"]], own[node["left"]]["n"] + own[node["right"]]["n"]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, a, b in ((node["right"], max(low, node["threshold"]), high), (node["left"], low, min(high, node["threshold"]))):
                stack.append((child, path | {f: (a, b, share * own[child]["n"] / total)}))
    return names, out


def expected(leaves: Sequence[Leaf]) -> float:
    """What the trees say when nothing is known."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def values_of(x: np.ndarray, leaves: Sequence[Leaf]) -> np.ndarray:
    """Shapley values (rows, features) of rows ``x`` (rows, features)."""
    out = np.zeros_like(x, dtype=np.float64)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        own = x[:, leaf.features]
        met = (own > leaf.low) & (own <= leaf.high)
        # extended by each feature: coefficient k belongs to the subsets of k known features
        path = np.zeros((len(x), d + 1))
        path[:, 0] = 1.0
        for j in range(d):
            path[:, 1:] = path[:, 1:] * leaf.share[j] + path[:, :-1] * met[:, j, None]
            path[:, 0] *= leaf.share[j]
        weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
        for j in range(d):
            share, known = leaf.share[j], met[:, j]
            rest = np.empty((len(x), d))
            # unwound: from the top where the feature is met, else by its share
            rest[known, d - 1] = path[known, d]
            for k in range(d - 1, 0, -1):
                rest[known, k - 1] = path[known, k] - share * rest[known, k]
            rest[~known] = path[~known, :d] / share if share > 0 else 0.0
            out[:, leaf.features[j]] += (rest @ weight) * (known - share) * leaf.value
    return out


def shapley(nodes: DataFrame, rows: DataFrame, id: str) -> DataFrame:
    """``(id, base, margin, contributions)`` of every row: an array of (feature, contribution), which with the base sums to the margin.

    Rows that repeat an id are explained each.
    """
    names, leaves = leaves_of(nodes)
    base = expected(leaves)
    sent = rows.sparkSession.sparkContext.broadcast(leaves)
    columns = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in names]
    ready = rows.select(F.col(id).alias("id"), F.array(*columns).cast("array<double>").alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=np.float64).reshape(len(batch), len(names))
            found = values_of(x, sent.value)
            yield pd.DataFrame({"id": batch["id"], "phi": list(found), "margin": base + found.sum(axis=1)})

    told = ready.mapInPandas(run, f"id {dict(ready.dtypes)['id']}, phi array<double>, margin double")
    named = F.arrays_zip(F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("feature"), F.col("phi").alias("contribution"))
    return told.select("id", F.lit(base).alias("base"), "margin", F.transform(named, lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution"))).alias("contributions"))


def strongest(explained: DataFrame, top: int = 5) -> DataFrame:
    """``explained`` with ``reasons``: the ``top`` contributions by size, largest first, ties by name."""
    order = lambda a, b: F.when(F.abs(a["contribution"]) > F.abs(b["contribution"]), -1).when(F.abs(a["contribution"]) < F.abs(b["contribution"]), 1).when(a["feature"] < b["feature"], -1).otherwise(1)
    return explained.withColumn("reasons", F.slice(F.array_sort("contributions", order), 1, top))


def summary(explained: DataFrame) -> DataFrame:
    """``(feature, importance, mean, share_positive)`` over the explained rows, most important first."""
    one = explained.select(F.explode("contributions").alias("c")).select("c.feature", "c.contribution")
    return one.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean"), F.avg((F.col("contribution") > 0).cast("double")).alias("share_positive")).orderBy(F.desc("importance"), "feature")
