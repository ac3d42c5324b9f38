"""Features and scores of a stream with the state of its entities.

The steps of a feature plan that look back at an entity's events become folds of one
stateful operator, in the order of event time; steps that look at the row alone,
or look up what was fitted, are applied as on a table.  The model runs in the same
query, so a stream's scores are those of a batch over the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chronolith.plans.features import FeaturePlan, Step
from chronolith.plans.training import Trained
from chronolith.spec import Roles
from chronolith.streaming import folds, ordered

#: Steps with a state for each entity.
FOLDED = {"amount": folds.Amounts, "history": folds.History, "aggregation": folds.Aggregation, "velocity": folds.Speeds}
#: Steps that need nothing but the row and what was fitted.
BY_ROW = {"time", "card", "address", "email", "cross", "device", "missing_pattern", "target_encoding", "label_encoding"}


def fold_of(step: Step, roles: Roles) -> folds.Fold | None:
    """The fold of a step, None for a step by row; a step that cannot run on a stream is an error."""
    if step.name in FOLDED:
        fold = FOLDED[step.name](roles, **step.params)
        return folds.Named(fold, step.instance) if step.instance else fold
    if step.name in BY_ROW or step.name == "uid" and not step.params.get("windows"):
        return None
    raise ValueError(f"step {step.name!r} does not run on a stream")


def streaming_steps(plan: FeaturePlan) -> list[str]:
    """The names of the plan's steps that keep state on a stream."""
    return [s.instance or s.name for s in plan.steps if s.name in FOLDED]


def plan_folds(plan: FeaturePlan, more: Sequence[folds.Fold] = ()) -> list[folds.Fold]:
    """The folds of all steps that have one, and ``more``."""
    return [f for s in plan.steps if (f := fold_of(s, plan.roles))] + list(more)


def features_in_order(stream: DataFrame, plan: FeaturePlan, late: str = "1 hour", tick: str = "second", idle: int | None = None, reset: str | None = None, warm: DataFrame | None = None, more: Sequence[folds.Fold] = ()) -> DataFrame:
    """``stream`` with the columns of all steps; ``warm`` (:func:`warm_states`) holds what came before it."""
    out = ordered.in_order(stream, plan.roles, plan_folds(plan, more), late, tick, idle, reset, warm)
    for k, step in enumerate(plan.steps):
        if step.name not in FOLDED:
            out = plan._apply(k, step, out)
    return out


def warm_states(history: DataFrame, plan: FeaturePlan, more: Sequence[folds.Fold] = ()) -> DataFrame:
    """The entities' states after ``history``, for :func:`features_in_order`."""
    return ordered.states_of(history, plan.roles, plan_folds(plan, more))


def score_in_order(stream: DataFrame, trained: Trained, late: str = "1 hour", tick: str = "second", idle: int | None = None, reset: str | None = None, warm: DataFrame | None = None, version: str = "1") -> DataFrame:
    """What :meth:`chronolith.plans.training.Trained.score` gives, event by event as the watermark passes."""
    featured = features_in_order(stream, trained.plan, late, tick, idle, reset, warm)
    return trained.score_features(featured.drop(reset) if reset else featured, version)
