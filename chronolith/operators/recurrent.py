"""A recurrent encoder of event sequences, trained in numpy on a bounded sample.

A gated cell (Cho et al., 2014) reads an entity's events in order; from its hidden
state a linear layer foretells the next event, and the error of that, masked where
a sequence has ended, is what training lowers.  The hidden state is the entity's
embedding, the error of an event against what was foretold its anomaly.  One
step needs the last hidden state only, so the encoder runs over streams.

Training looks at no more than ``sample`` entities and the last ``length`` events
of each; both are parameters.  Encoding covers all events of all entities.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.sequence import sequence_tail
from chronolith.spec import Roles

#: Parameters of the cell and of the foretelling layer, in order.
NAMES = ("wx", "wh", "b", "vx", "vh", "c", "out", "bias")


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class RecurrentEncoder:
    """``weights``: update and reset gates (wx, wh, b), candidate (vx, vh, c), and the next event (out, bias)."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.weights["vh"].shape[0]

    def start(self) -> np.ndarray:
        return np.zeros(self.hidden)

    def step(self, hidden: Sequence[float], values: Sequence[float]) -> tuple[np.ndarray, float]:
        """The state after an event, and the mean squared error of what the state before foretold."""
        w, h = self.weights, np.asarray(hidden)
        x = (np.asarray(values) - self.mean) * self.scale
        error = float(np.mean((h @ w["out"] + w["bias"] - x) ** 2))
        gates = _gate(x @ w["wx"] + h @ w["wh"] + w["b"])
        update, reset = gates[: len(h)], gates[len(h) :]
        candidate = np.tanh(x @ w["vx"] + (reset * h) @ w["vh"] + w["c"])
        return (1 - update) * h + update * candidate, error

    def encode(self, sequences: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last states and mean errors of padded sequences (n, length, features)."""
        x = (sequences - self.mean) * self.scale
        states, errors, _ = _forward(self.weights, x, lengths)
        return states[np.arange(len(x)), lengths], errors

    def transform(self, df: DataFrame, roles: Roles, length: int = 20) -> DataFrame:
        """``(key, n, embedding, anomaly)`` of each entity's last ``length`` events, batch by batch."""
        tails = sequence_tail(df, roles, self.features, length)
        key = dict(tails.dtypes)[roles.key]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                states, errors = self.encode(*_padded(rows["sequence"], len(self.features)))
                yield pd.DataFrame({roles.key: rows[roles.key], "n": rows["n"], "embedding": list(states), "anomaly": errors})

        return tails.mapInPandas(run, f"`{roles.key}` {key}, n int, embedding array<double>, anomaly double")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "mean": self.mean.tolist(), "scale": self.scale.tolist(), "weights": {k: v.tolist() for k, v in self.weights.items()}})

    @staticmethod
    def from_json(text: str) -> RecurrentEncoder:
        d = json.loads(text)
        return RecurrentEncoder(d["features"], np.array(d["mean"]), np.array(d["scale"]), {k: np.array(v) for k, v in d["weights"].items()})


def _padded(sequences: Sequence, width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    out = np.zeros((len(lengths), max(lengths.max(initial=0), 1), width))
    for k, s in enumerate(sequences):
        if len(s):
            out[k, : len(s)] = np.array([list(x) for x in s])
    return out, lengths


def _forward(w: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """States before each step and after the last (n, length + 1, hidden), mean errors, and what going back needs."""
    n, length, width = x.shape
    size = w["vh"].shape[0]
    states, kept, total = np.zeros((n, length + 1, size)), [], np.zeros(n)
    for t in range(length):
        h, now = states[:, t], (t < lengths)[:, None]
        off = (h @ w["out"] + w["bias"] - x[:, t]) * now
        total += (off**2).mean(axis=1)
        gates = _gate(x[:, t] @ w["wx"] + h @ w["wh"] + w["b"])
        update, reset = gates[:, :size], gates[:, size:]
        candidate = np.tanh(x[:, t] @ w["vx"] + (reset * h) @ w["vh"] + w["c"])
        states[:, t + 1] = np.where(now, (1 - update) * h + update * candidate, h)
        kept.append((off, now, update, reset, candidate))
    return states, total / np.maximum(lengths, 1), kept


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The masked loss (mean squared error of all events) and its derivative, through time."""
    states, errors, kept = _forward(w, x, lengths)
    width, size, count = x.shape[2], w["vh"].shape[0], max(int(lengths.sum()), 1)
    loss = float((errors * lengths).sum() / count)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    after = np.zeros((len(x), size))
    for t in reversed(range(x.shape[1])):
        off, now, update, reset, candidate = kept[t]
        h = states[:, t]
        # through the state after this event
        at = after * now
        d_candidate = at * update * (1 - candidate**2)
        back = d_candidate @ w["vh"].T
        d_update = at * (candidate - h) * update * (1 - update)
        d_reset = back * h * reset * (1 - reset)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        g["vx"] += x[:, t].T @ d_candidate
        g["vh"] += (reset * h).T @ d_candidate
        g["c"] += d_candidate.sum(axis=0)
        g["wx"] += x[:, t].T @ d_gates
        g["wh"] += h.T @ d_gates
        g["b"] += d_gates.sum(axis=0)
        # through what the state before foretold of this event
        d_off = 2 * off / (width * count)
        g["out"] += h.T @ d_off
        g["bias"] += d_off.sum(axis=0)
        after = after * ~now + at * (1 - update) + back * reset + d_gates @ w["wh"].T + d_off @ w["out"].T
    return loss, g


def initial(width: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda a, b: rng.standard_normal((a, b)) / np.sqrt(a)
    return {"wx": normal(width, 2 * hidden), "wh": normal(hidden, 2 * hidden), "b": np.zeros(2 * hidden), "vx": normal(width, hidden), "vh": normal(hidden, hidden), "c": np.zeros(hidden), "out": normal(hidden, width), "bias": np.zeros(width)}


def fit_arrays(sequences: np.ndarray, lengths: np.ndarray, features: Sequence[str], hidden: int = 16, epochs: int = 60, rate: float = 0.01, batch: int = 256, seed: int = 0) -> RecurrentEncoder:
    """Adam over shuffled batches of padded sequences; the same seed gives the same encoder."""
    mask = np.arange(sequences.shape[1])[None, :] < lengths[:, None]
    known = sequences[mask]
    mean = known.mean(axis=0) if len(known) else np.zeros(len(features))
    spread = known.std(axis=0) if len(known) else np.zeros(len(features))
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1), 1.0)
    x, w, rng = (sequences - mean) * scale, initial(len(features), hidden, seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    count = 0
    for _ in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            _, g = _gradients(w, x[some], lengths[some])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            count += 1
            for k in NAMES:
                step = g[k] / max(norm, 1.0)
                first[k] = 0.9 * first[k] + 0.1 * step
                second[k] = 0.999 * second[k] + 0.001 * step**2
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)
    return RecurrentEncoder(list(features), mean, scale, w)


def fit(df: DataFrame, roles: Roles, features: Sequence[str], length: int = 20, sample: int = 2000, **options) -> RecurrentEncoder:
    """Fit on the last ``length`` events of at most ``sample`` entities, those that come first by a hash of the key."""
    chosen = df.where(F.col(roles.key).isNotNull()).select(roles.key).distinct().orderBy(F.xxhash64(roles.key), roles.key).limit(sample)
    tails = sequence_tail(df.join(F.broadcast(chosen), roles.key, "left_semi"), roles, features, length).orderBy(roles.key)
    return fit_arrays(*_padded([r["sequence"] for r in tails.select("sequence").collect()], len(features)), features, **options)
