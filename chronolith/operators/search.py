"""Parameter search over a space: seeded draws and successive halving on purged time folds.

A space names parameters with their ranges: ``("int", low, high)`` and
``("float", low, high)`` are even, ``("log", low, high)`` is even in the
logarithm, ``("choice", values)`` is one of a list.  All trials start with a small
budget; of each rung the best share goes on with a larger one, so most of the
work goes to trials that deserve it (Jamieson and Talwalkar, 2016).  The same seed
gives the same trials.  Features and folds are made once and read by every trial.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import metrics, models
from chronolith.operators.tables import purged_folds
from chronolith.storage import written


@dataclass(frozen=True)
class Result:
    """One trial at one rung."""

    trial: int
    rung: int
    budget: int
    params: dict
    score: float


def draw(space: dict[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    """``trials`` draws; parameters are drawn by name, so their order in the space does not matter."""
    rng, out = np.random.default_rng(seed), []
    for name, (kind, *bounds) in space.items():
        if kind not in ("int", "float", "log", "choice"):
            raise ValueError(f"{name}: unknown kind {kind!r}: int, float, log or choice")
        if kind == "choice" and not bounds[0] or kind != "choice" and (bounds[0] > bounds[1] or kind == "log" and bounds[0] <= 0):
            raise ValueError(f"{name}: empty range {bounds}")
    for _ in range(trials):
        one: dict = {}
        for name in sorted(space):
            kind, *bounds = space[name]
            u = float(rng.random())
            if kind == "choice":
                one[name] = bounds[0][min(int(u * len(bounds[0])), len(bounds[0]) - 1)]
            elif kind == "int":
                one[name] = min(bounds[0] + int(u * (bounds[1] - bounds[0] + 1)), bounds[1])
            elif kind == "log":
                one[name] = math.exp(math.log(bounds[0]) + u * (math.log(bounds[1]) - math.log(bounds[0])))
            else:
                one[name] = bounds[0] + u * (bounds[1] - bounds[0])
        out.append(one)
    return out


def halving(trials: Sequence[dict], objective: Callable[[dict, int], float], least: int, most: int, factor: int = 3) -> list[Result]:
    """Every rung of successive halving, the last one first to read: ``max(..., key=score)`` of the last rung is the best.

    ``objective(params, budget)`` is to be large.  Budgets grow from ``least`` to
    ``most`` by ``factor``; the best of a rung, one in ``factor`` and one at least, go
    on; ties go to the earlier trial.  NaN counts as the worst.
    """
    alive, budget, rung, out = list(range(len(trials))), min(least, most), 0, []
    while alive:
        scored = [Result(k, rung, budget, trials[k], objective(trials[k], budget)) for k in alive]
        out += scored
        if budget >= most:
            break
        ranked = sorted(scored, key=lambda r: (r.score != r.score, -r.score if r.score == r.score else 0.0, r.trial))
        alive = sorted(r.trial for r in ranked[: max(1, len(ranked) // factor)])
        budget, rung = min(budget * factor, most), rung + 1
    return out


def best(results: Sequence[Result]) -> Result:
    """The best trial of the last rung; the earlier of equal ones."""
    last = max(r.rung for r in results)
    return min((r for r in results if r.rung == last), key=lambda r: (r.score != r.score, -r.score if r.score == r.score else 0.0, r.trial))


def search(df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str], space: dict[str, tuple], kind: str = "gbt", trials: int = 9, budget: tuple[str, int, int] = ("maxIter", 3, 27), factor: int = 3, n_splits: int = 2, purge: int = 0, seed: int = 42) -> tuple[dict, list[Result]]:
    """The best parameters with the full budget, and all results: the mean AUC over purged time folds.

    ``df`` has the features.  ``budget`` names the parameter that makes a trial dear
    (rounds, trees, iterations), with its least and its full value.
    """
    name, least, most = budget
    folds = written(purged_folds(df.select(*dict.fromkeys([*columns, target, *order])), order, n_splits, purge), "search-folds")
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())

    def objective(params: dict, amount: int) -> float:
        rows = []
        for k in numbers:
            own = folds.where(F.col("fold") == k)
            model = models.fit(own.where("not is_val"), columns, target, kind, **{**params, name: amount})
            rows.append(metrics.roc_auc(model.score(own.where("is_val")), "p", target).select("auc"))
        if not rows:
            return float("nan")
        whole = rows[0]
        for r in rows[1:]:
            whole = whole.unionByName(r)
        found = whole.agg(F.avg("auc")).first()[0]
        return float("nan") if found is None else float(found)

    results = halving(draw(space, trials, seed), objective, least, most, factor)
    return {**best(results).params, name: most}, results


def report(spark: SparkSession, results: Sequence[Result]) -> DataFrame:
    """``(trial, rung, budget, params, score)`` with the parameters as JSON."""
    rows = [(r.trial, r.rung, r.budget, json.dumps(r.params, sort_keys=True), r.score) for r in results]
    return spark.createDataFrame(rows, "trial int, rung int, budget int, params string, score double")
