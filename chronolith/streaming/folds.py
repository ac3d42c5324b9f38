"""What an entity's earlier events say about the next one, one event at a time.

A fold keeps a small state for an entity and is fed its events in order; it gives
the values that the operators of :mod:`chronolith.operators.history` give for
the same rows as a batch, so one plan serves both.  States are plain lists of
numbers: they are kept as JSON, whose floats come back exact.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

from chronolith.operators.history import STATS
from chronolith.operators.recurrent import RecurrentEncoder
from chronolith.operators.rules import Amount, RuleEngine, Velocity
from chronolith.spec import Roles


def _number(value: object) -> float | None:
    """A float, None for null and NaN."""
    return None if value is None or value != value else float(value)  # type: ignore[arg-type]


class Fold:
    """``outputs`` names the new columns and their types, ``reads`` the columns of an event that it looks at.

    ``memory`` is how many ticks after an event its state can still matter, None for ever.
    """

    outputs: dict[str, str]
    reads: list[str]
    memory: int | None = None

    def start(self) -> list:
        raise NotImplementedError

    def step(self, state: list, time: int, values: dict) -> list:
        """The outputs for an event, in order; ``state`` takes the event in."""
        raise NotImplementedError


@dataclass
class RecentCount(Fold):
    """``n_recent``: events of the last ``width`` ticks, this one included."""

    width: int
    name: str = "n_recent"

    def __post_init__(self) -> None:
        self.outputs, self.reads, self.memory = {self.name: "long"}, [], self.width

    def start(self) -> list:
        return []

    def step(self, state: list, time: int, values: dict) -> list:
        state.append(time)
        del state[: bisect_left(state, time - self.width)]
        return [len(state)]


class History(Fold):
    """:func:`chronolith.operators.history.history_features`."""

    def __init__(self, roles: Roles, windows: Sequence[int] = (3600,), stats: Sequence[str] = ("count", "sum", "mean"), columns: Sequence[str] | None = None):
        if unknown := set(stats) - set(STATS):
            raise ValueError(f"unknown statistics: {sorted(unknown)}")
        self.windows, self.stats, self.amount = list(windows), set(stats), roles.amount
        self.columns = [roles.amount] if columns is None else list(columns)
        self.reads = list(dict.fromkeys([roles.amount, *self.columns]))
        self.outputs = {"time_since_last": "long", "cumulative_spend": "double"}
        for w in self.windows:
            if "count" in stats:
                self.outputs[f"tx_count_last_{w}s"] = "long"
            for c in self.columns:
                self.outputs |= {f"{c}_{s}_last_{w}s": "double" for s in STATS[1:] if s in stats}

    def start(self) -> list:
        # spent so far, last time, times, and the values of each column
        return [0.0, None, [], [[] for _ in self.columns]]

    def step(self, state: list, time: int, values: dict) -> list:
        spent, last, times, held = state
        out: list = [0 if last is None else time - last, spent]
        gone = bisect_left(times, time - max(self.windows, default=0))
        del times[:gone]
        for column in held:
            del column[:gone]
        for w in self.windows:
            first = bisect_left(times, time - w)
            n = len(times) - first
            if "count" in self.stats:
                out.append(n)
            for column in held:
                recent = column[first:]
                known = [v for v in recent if v is not None]
                total = math.fsum(known)
                mean = total / n if n else 0.0
                each = {"sum": total, "mean": mean, "min": min(known, default=0.0), "max": max(known, default=0.0)}
                if "std" in self.stats:
                    each["std"] = math.sqrt(math.fsum(((v or 0.0) - mean) ** 2 for v in recent) / n) if n > 1 else 0.0
                out += [each[s] for s in STATS[1:] if s in self.stats]
        state[0] += _number(values[self.amount]) or 0.0
        state[1] = time
        times.append(time)
        for name, column in zip(self.columns, held, strict=True):
            column.append(_number(values[name]))
        return out


class Aggregation(Fold):
    """:func:`chronolith.operators.history.prior_aggregates` by the entity: a count, and sums that are updated, for each column."""

    def __init__(self, roles: Roles, group_keys: Sequence[Sequence[str]], columns: Sequence[str] | None = None, stats: Sequence[str] = ("count", "sum", "mean", "std"), suffix: str = ""):
        if [list(k) for k in group_keys] != [[roles.key]]:
            raise ValueError(f"a stream is keyed by {roles.key}: {group_keys}")
        self.columns, self.stats = [roles.amount] if columns is None else list(columns), list(stats)
        self.reads = self.columns
        self.outputs = {f"{roles.key}_{c}_{s}{suffix}": "long" if s == "count" else "double" for c in self.columns for s in self.stats}

    def start(self) -> list:
        # events; for each column: known values, sum, mean, squares around it, least, greatest
        return [0, [[0, 0.0, 0.0, 0.0, None, None] for _ in self.columns]]

    def step(self, state: list, time: int, values: dict) -> list:
        n, out = state[0], []
        for name, held in zip(self.columns, state[1], strict=True):
            known, total, mean, squares, low, high = held
            each = {"count": n, "sum": total, "mean": total / n if n else 0.0, "std": math.sqrt(squares / (known - 1)) if known > 1 else 0.0, "min": low or 0.0, "max": high or 0.0}
            out += [each[s] for s in self.stats]
            value = _number(values[name])
            if value is not None:
                off = value - mean
                mean += off / (known + 1)
                held[:] = [known + 1, total + value, mean, squares + off * (value - mean), value if low is None else min(low, value), value if high is None else max(high, value)]
        state[0] += 1
        return out


class Amounts(Fold):
    """:func:`chronolith.operators.history.amount_features`."""

    def __init__(self, roles: Roles):
        self.amount, self.reads = roles.amount, [roles.amount]
        self.outputs = {"log_amount": "double", "is_integer_amount": "int", "is_first_trx": "int", "amount_delta": "double", "amount_ratio": "double"}

    def start(self) -> list:
        # the last amount, and how many known ones with what sum
        return [None, 0, 0.0]

    def step(self, state: list, time: int, values: dict) -> list:
        last, n, total = state
        amount = _number(values[self.amount])
        known = amount or 0.0
        mean = total / n if n else None
        out = [math.log1p(known) if known > -1 else None, int(known == math.floor(known)), int(last is None), 0.0 if amount is None or last is None else amount - last, amount / mean if mean and amount is not None else 1.0]
        state[:] = [amount, n + (amount is not None), total + known]
        return out


class Speeds(Fold):
    """:func:`chronolith.operators.history.velocity_features`."""

    def __init__(self, roles: Roles):
        self.amount, self.reads = roles.amount, [roles.amount]
        self.outputs = {"velocity": "double", "acceleration": "double"}

    def start(self) -> list:
        # last amount, time and velocity
        return [None, None, 0.0]

    def step(self, state: list, time: int, values: dict) -> list:
        last, at, speed = state
        amount = _number(values[self.amount])
        change = 0.0 if amount is None or last is None else amount - last
        passed = 0 if at is None else time - at
        now = change / passed if passed else 0.0
        state[:] = [amount, time, now]
        return [now, (now - speed) / passed if passed else 0.0]


class LastRows(Fold):
    """``n`` and ``sequence``: the last ``length`` events, this one included, null features as 0."""

    def __init__(self, features: Sequence[str], length: int = 20):
        self.reads, self.length = list(features), length
        self.outputs = {"n": "int", "sequence": "array<array<double>>"}

    def start(self) -> list:
        return []

    def step(self, state: list, time: int, values: dict) -> list:
        state.append([_number(values[c]) or 0.0 for c in self.reads])
        del state[: -self.length]
        return [len(state), [list(x) for x in state]]


class Ruled(Fold):
    """``rule`` and ``rule_action`` of :class:`chronolith.operators.rules.RuleEngine`: the first rule that fires decides.

    A blacklist's answer is a boolean column of the event, named in ``listed`` by
    rule; a velocity rule counts the events that no rule before it decided.
    """

    def __init__(self, engine: RuleEngine, roles: Roles, listed: dict[str, str]):
        # plain values: a blacklist holds a table, which no task can
        kinds = [("velocity", r.width, r.most) if isinstance(r, Velocity) else ("amount", 0, r.limit) if isinstance(r, Amount) else ("listed", 0, listed[r.name]) for r in engine.rules]
        self.rules = [(*kind, r.name, r.action) for kind, r in zip(kinds, engine.rules, strict=True)]
        self.amount, self.reads = roles.amount, [roles.amount, *listed.values()]
        self.outputs = {"rule": "string", "rule_action": "string"}
        self.memory = max([width for _, width, *_ in self.rules], default=0)

    def start(self) -> list:
        return [[] for _ in self.rules]

    def step(self, state: list, time: int, values: dict) -> list:
        for (kind, width, limit, name, action), times in zip(self.rules, state, strict=True):
            if kind == "velocity":
                times.append(time)
                del times[: bisect_left(times, time - width)]
                fires = len(times) > limit
            elif kind == "amount":
                amount = _number(values[self.amount])
                fires = amount is not None and amount > limit
            else:
                fires = bool(values[limit])
            if fires:
                return [name, action]
        return [None, None]


class Named(Fold):
    """``fold`` with a suffix to its columns, for a named instance of a step."""

    def __init__(self, fold: Fold, suffix: str):
        self.fold, self.reads, self.memory = fold, fold.reads, fold.memory
        self.outputs = {f"{n}_{suffix}": t for n, t in fold.outputs.items()}
        self.start, self.step = fold.start, fold.step  # type: ignore[method-assign]


class Recurrent(Fold):
    """One cell step of a fitted encoder for each event: the embedding of all events so far, and how unexpected the event was."""

    def __init__(self, encoder: RecurrentEncoder, prefix: str = "seq"):
        self.encoder, self.reads = encoder, encoder.features
        self.outputs = {f"{prefix}_embedding": "array<double>", f"{prefix}_anomaly": "double"}

    def start(self) -> list:
        return self.encoder.start().tolist()

    def step(self, state: list, time: int, values: dict) -> list:
        hidden, error = self.encoder.step(state, [_number(values[c]) or 0.0 for c in self.reads])
        state[:] = hidden.tolist()
        return [hidden.tolist(), error]
