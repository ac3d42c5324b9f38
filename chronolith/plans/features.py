"""Feature steps in order: each is fitted on training rows, then applied to any rows."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from chronolith.functions import rows
from chronolith.operators import encoders, graph, history
from chronolith.spec import Roles
from chronolith.storage import written


@dataclass
class Step:
    """A named step.  ``fit`` returns state (tables or plain values) or None; ``apply`` adds columns."""

    name: str
    apply: Callable[..., DataFrame]
    fit: Callable[..., object] | None = None
    params: dict = field(default_factory=dict)
    uses_target: bool = False
    instance: str | None = None

    @property
    def stateful(self) -> bool:
        return self.fit is not None


def _uid_fit(df: DataFrame, roles: Roles, columns: Sequence[str], windows: Sequence[int] = ()) -> DataFrame:
    return written(encoders.fit_uid(df, roles, columns), "uid-state")


def _uid_apply(df: DataFrame, state: DataFrame, roles: Roles, columns: Sequence[str], windows: Sequence[int] = ()) -> DataFrame:
    return encoders.uid_features(df, state, roles, columns, windows)


#: Steps by name: (apply, fit, uses the target).
STEPS: dict[str, tuple[Callable, Callable | None, bool]] = {
    "time": (lambda df, roles: rows.time_features(df, roles.time), None, False),
    "amount": (history.amount_features, None, False),
    "history": (history.history_features, None, False),
    "aggregation": (history.prior_aggregates, None, False),
    "velocity": (history.velocity_features, None, False),
    "card": (lambda df, roles: rows.card_features(df), None, False),
    "address": (lambda df, roles, **k: rows.address_features(df, **k), None, False),
    "email": (lambda df, roles, column: rows.email_features(df, column), None, False),
    "cross": (lambda df, roles, **k: rows.cross_features(df, **k), None, False),
    "device": (lambda df, roles, **k: rows.device_features(df, **k), None, False),
    "graph_history": (graph.entity_history, None, True),
    "graph_distinct": (graph.distinct_before, None, False),
    "component_size": (graph.component_size, None, False),
    "missing_pattern": (lambda df, state, roles: encoders.missing_pattern(df, state), lambda df, roles: encoders.fit_missing_pattern(df), False),
    "target_encoding": (lambda df, state, roles, column, **k: encoders.target_encode(df, state, column), lambda df, roles, column, **k: written(encoders.fit_target_encoding(df, column, roles.target, **k), "target-state"), True),
    "label_encoding": (lambda df, state, roles, column: encoders.label_encode(df, state, column), lambda df, roles, column: written(encoders.fit_label_encoding(df, column), "label-state"), False),
    "uid": (_uid_apply, _uid_fit, False),
}


#: The function behind each step whose parameters pass through.
BEHIND: dict[str, Callable] = {"time": rows.time_features, "card": rows.card_features, "address": rows.address_features, "email": rows.email_features, "cross": rows.cross_features, "device": rows.device_features, "missing_pattern": encoders.missing_pattern, "target_encoding": encoders.fit_target_encoding, "label_encoding": encoders.fit_label_encoding, "uid": encoders.fit_uid}


def schema_of(name: str) -> dict:
    """What a step is and takes: its parameters with types, defaults and whether they are required, and an example of a plan's entry."""
    if name not in STEPS:
        raise ValueError(f"unknown feature step {name!r}: {', '.join(sorted(STEPS))}")
    apply, fit, target = STEPS[name]
    behind = BEHIND.get(name, apply)
    found: dict[str, inspect.Parameter] = {}
    for function in (apply, fit, behind):
        own = inspect.signature(function).parameters.values() if function else ()
        # without a rest, only what the step itself names can be given
        through = function is not behind or any(p.kind is p.VAR_KEYWORD for f in (apply, fit) if f for p in inspect.signature(f).parameters.values()) or behind is apply
        for p in own if through else ():
            if p.kind is not p.VAR_KEYWORD and p.name not in ("df", "train", "state", "roles", "time", "target"):
                found.setdefault(p.name, p)
    parameters = [{"name": p.name, "type": "any" if p.annotation is p.empty else str(p.annotation), "required": p.default is p.empty, "default": None if p.default is p.empty else p.default} for p in found.values()]
    needed = {p["name"]: f"<{p['name']}>" for p in parameters if p["required"]}
    about = (inspect.getdoc(behind) or name).splitlines()[0]
    return {"step": name, "description": about, "is_stateful": fit is not None, "depends_on_target": target, "needs_history": name in HISTORY, "parameters": parameters, "example": {name: needed} if needed else name}


def schemas(spark: SparkSession) -> DataFrame:
    """``(step, description, is_stateful, depends_on_target, needs_history, parameter, type, required, default)`` of all steps; a step without parameters is one row."""
    out = []
    for name in sorted(STEPS):
        s = schema_of(name)
        head = (name, s["description"], s["is_stateful"], s["depends_on_target"], s["needs_history"])
        out += [(*head, p["name"], p["type"], p["required"], json.dumps(p["default"], default=str)) for p in s["parameters"]] or [(*head, None, None, None, None)]
    return spark.createDataFrame(out, "step string, description string, is_stateful boolean, depends_on_target boolean, needs_history boolean, parameter string, type string, required boolean, default string")


#: Steps that look at an entity's earlier rows: scoring an event alone gives them no history.
HISTORY = frozenset({"amount", "history", "aggregation", "velocity", "graph_history", "graph_distinct", "component_size", "uid"})


def configure(spec: Sequence[str | dict]) -> list[Step]:
    """Steps from names or ``{name: params}``; an unknown name is an error, and so is an unknown parameter on use.

    The parameter ``instance`` names one of several steps of a kind: its columns
    end in ``_<instance>``.
    """
    out = []
    for item in spec:
        name, params = (item, {}) if isinstance(item, str) else next(iter(item.items()))
        if name not in STEPS:
            raise ValueError(f"unknown feature step {name!r}: {', '.join(sorted(STEPS))}")
        apply, fit, target = STEPS[name]
        params = dict(params)
        instance = params.pop("instance", None)
        out.append(Step(name, apply, fit, params, target, instance))
    return out


class FeaturePlan:
    """Configured steps; each is fitted on what the steps before it made."""

    def __init__(self, steps: Sequence[Step], roles: Roles):
        self.steps, self.roles, self.state = list(steps), roles, {}
        self.made: dict[str, list[str]] = {}

    def fit_transform(self, train: DataFrame) -> DataFrame:
        for k, step in enumerate(self.steps):
            if step.stateful:
                self.state[k] = step.fit(train, self.roles, **step.params)
            before = set(train.columns)
            train = self._apply(k, step, train)
            self.made[f"{k}:{step.name}"] = [c for c in train.columns if c not in before]
        return train

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply to other rows; windows see the rows of ``df`` only."""
        for k, step in enumerate(self.steps):
            df = self._apply(k, step, df)
        return df

    @property
    def needs_history(self) -> bool:
        """Whether events scored alone lack the history that the steps were trained on."""
        return any(s.name in HISTORY for s in self.steps)

    def _apply(self, k: int, step: Step, df: DataFrame) -> DataFrame:
        """The step's columns beside those of ``df``; a column that is there already is an error, unless the step is a named instance."""
        made = {c for step_made in self.made.values() for c in step_made} if step.instance else set()
        kept = {c: f"_kept_{c}" for c in df.columns if c in made}
        base = df.withColumnsRenamed(kept)
        out = step.apply(base, self.state[k], self.roles, **step.params) if step.stateful else step.apply(base, self.roles, **step.params)
        if step.instance:
            new = {c: f"{c}_{step.instance}" for c in out.columns if c not in base.columns}
            out = out.withColumnsRenamed(new).withColumnsRenamed({v: c for c, v in kept.items()})
        twice = sorted({c for c in out.columns if out.columns.count(c) > 1})
        if twice:
            raise ValueError(f"step {k} ({step.name}) makes columns that are there already: {', '.join(twice)}")
        return out

    def entries(self) -> list[dict]:
        """What each step made, as plain values for a :class:`chronolith.plans.feature_catalog.FeatureCatalog`."""
        return [{"source": s.instance or s.name, "feature_names": self.made.get(f"{k}:{s.name}", []), "depends_on_target": s.uses_target, "is_stateful": s.stateful} for k, s in enumerate(self.steps)]

    def catalog(self, spark: SparkSession) -> DataFrame:
        """``(step, feature, stateful, uses_target)`` of every column made."""
        made = [(s.name, c, s.stateful, s.uses_target) for k, s in enumerate(self.steps) for c in self.made.get(f"{k}:{s.name}", [])]
        return spark.createDataFrame(made, "step string, feature string, stateful boolean, uses_target boolean")

    def save(self, path: str) -> None:
        """Fitted tables as Parquet and plain values as JSON below ``path``."""
        for k, value in self.state.items():
            if isinstance(value, DataFrame):
                value.write.mode("overwrite").parquet(f"{path}/{k}")
            else:
                from pyspark.sql import SparkSession as S

                S.getActiveSession().createDataFrame([(json.dumps(value),)], "value string").write.mode("overwrite").text(f"{path}/{k}-json")

    def load(self, spark: SparkSession, path: str) -> FeaturePlan:
        for k, step in enumerate(self.steps):
            if step.stateful:
                self.state[k] = json.loads(spark.read.text(f"{path}/{k}-json").first()[0]) if step.name == "missing_pattern" else spark.read.parquet(f"{path}/{k}")
        return self
