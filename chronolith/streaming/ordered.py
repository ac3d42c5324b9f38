"""Folds over a stream in the order of event time, and the same over a table.

Events wait in a state until the watermark has passed them; then a
timer takes them out by ``(time, id)`` and feeds them to their entity's folds.  So an event that
comes late, but within the watermark, counts where it belongs, events after it see
it, and every result is final: a stream gives what a batch over the same rows
gives, however they are cut into files.  The price is that a result comes when the
watermark passes its event; events that are later than that are dropped by
Spark, and counted in the query's progress.

State is the waiting events and the folds' states.  Entities share it by a hash, in
``buckets``: calls of state and timers and frames cost milliseconds each, so there is
one of each for a bucket and batch, not for an entity.  A batch reads and rewrites
the states of the buckets it touches, and a task holds one bucket's events at a time.

An entity's fold states end
``idle`` ticks after its last event (by event time; by default when no fold can
tell the difference, which folds without end never say).  ``reset`` names a boolean
column: a row where it is true empties its entity's fold states at its place in
time and is no event.  A far later reset row of any entity also moves the
watermark, so that all events before it come out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from chronolith.spec import Roles
from chronolith.streaming.folds import Fold
from chronolith.streaming.stateful import SHIFT, TICKS, timed

#: Keys of the state, each shared by many entities.
BUCKETS = 1024
#: Events in a piece of a bucket's waiting events, and in a frame.
PIECE = 10_000
#: The state store that keeps lists and timers by key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _plain(value: object) -> object:
    """A column's value as plain Python, NaN and NaT of nullable columns as None."""
    if hasattr(value, "item"):
        value = value.item()
    return None if value is None or value is pd.NaT or value != value else value


class _States:
    """The folds' states of an entity, and their outputs for its events."""

    def __init__(self, folds: Sequence[Fold], roles: Roles, columns: Sequence[str], reset: str | None):
        self.folds, self.columns = list(folds), list(columns)
        self.time, self.id, self.key = (self.columns.index(c) for c in (roles.time, roles.id, roles.key))
        self.reset = None if reset is None else self.columns.index(reset)
        self.outputs = [n for f in self.folds for n in f.outputs]

    def start(self) -> list:
        return [f.start() for f in self.folds]

    def take(self, states: list, rows: Sequence[tuple]) -> tuple[list, list[tuple]]:
        """States after ``rows``, which are in order, and the rows with outputs."""
        out = []
        for row in rows:
            if self.reset is not None and row[self.reset]:
                states = self.start()
                continue
            values = dict(zip(self.columns, row, strict=True))
            found: list = []
            for fold, state in zip(self.folds, states, strict=True):
                found += fold.step(state, row[self.time], values)
            out.append((*row, *found))
        return states, out

    def place(self, row: tuple) -> tuple:
        return row[self.time], row[self.id]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.columns, *self.outputs], dtype=object)


def _put(state, rows: list[tuple]) -> None:
    """``rows`` in place of a list state's; none clear it."""
    if rows:
        state.put(rows)
    else:
        state.clear()


class _InOrder(StatefulProcessor):
    """One bucket of entities: ``waiting`` events, the folds' states, and timers at the first waiting event and at the first end of an entity's states."""

    def __init__(self, states: _States, schema: StructType | None, tick: str, idle: int | None, held: StructType | None = None):
        self.states, self.schema, self.held_schema, self.tick, self.idle = states, schema, held, tick, idle
        # pieces of waiting events are lists, one for each column, the key's first
        self.order = [states.key, *(k for k in range(len(states.columns)) if k != states.key)]
        self.places = [self.order.index(k) for k in range(len(states.columns))]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.held = handle.getListState("held", self.held_schema)
        self.now, self.done = None, set()

    def _ms(self, time: int) -> int:
        # the watermark is in whole milliseconds; a time inside one is past when the next is reached
        return -(-(time * TICKS[self.tick] + SHIFT) // 1000)

    def _pieces(self, rows: list[tuple]) -> list[tuple]:
        return [tuple([r[k] for r in rows[i : i + PIECE]] for k in self.order) for i in range(0, len(rows), PIECE)]

    def _waiting(self) -> Iterator[tuple]:
        for piece in self.waiting.get():
            yield from zip(*(piece[k] for k in self.places), strict=True)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # by place: the optimizer may give a renamed column back its old name
        width = len(self.states.columns)
        first = None
        for part in rows:
            new = [tuple(_plain(v) for v in r[:width]) for r in part.itertuples(index=False, name=None)]
            if new:
                self.waiting.appendList(self._pieces(new))
                least = min(r[self.states.time] for r in new)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(self._ms(first), timerValues.getCurrentWatermarkInMs() + 1))
        # nothing comes out yet; a frame, even an empty one, costs more than the events of most entities
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if now != self.now:
            self.now, self.done = now, set()
        # a bucket's first timer of a batch does all that is due; timers that it sets are later ones
        if key in self.done:
            return
        self.done.add(key)
        ready: dict[object, list[tuple]] = {}
        rest = []
        past = (now * 1000 - SHIFT) // TICKS[self.tick]
        for row in self._waiting():
            if row[self.states.time] <= past:
                ready.setdefault(row[self.states.key], []).append(row)
            else:
                rest.append(row)
        held = {name: (states, last) for name, states, last in self.held.get()}
        out: list[tuple] = []
        for name, rows in ready.items():
            rows.sort(key=self.states.place)
            before = held.get(name)
            states, found = self.states.take(json.loads(before[0]) if before else self.states.start(), rows)
            held[name] = json.dumps(states), rows[-1][self.states.time]
            out += found
            while len(out) >= PIECE:
                yield self.states.frame(out[:PIECE])
                del out[:PIECE]
        if out:
            yield self.states.frame(out)
        kept = held if self.idle is None else {name: of for name, of in held.items() if self._ms(of[1] + self.idle) >= now}
        if ready or len(kept) < len(held):
            _put(self.held, [(name, *of) for name, of in kept.items()])
        if ready:
            _put(self.waiting, self._pieces(rest))
        if rest:
            self.handle.registerTimer(max(self._ms(min(r[self.states.time] for r in rest)), now + 1))
        if self.idle is not None and kept:
            self.handle.registerTimer(max(self._ms(min(last for _, last in kept.values()) + self.idle) + 1, now + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.held.appendList([(_plain(name), states, int(last)) for name, states, last, *_ in initialState.itertuples(index=False, name=None)])

    def close(self) -> None:
        pass


def _schema(df: DataFrame, columns: Sequence[str], folds: Sequence[Fold]) -> str:
    types = dict(df.dtypes)
    made = {n: t for f in folds for n, t in f.outputs.items()}
    if twice := sorted(set(made) & set(columns)):
        raise ValueError(f"columns that are there already: {', '.join(twice)}")
    return ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"`{n}` {t}" for n, t in made.items()])


def _idle(folds: Sequence[Fold]) -> int | None:
    """How long after an entity's last event its states can matter; None for ever."""
    memories = [f.memory for f in folds]
    return None if any(m is None for m in memories) else max(memories, default=0)


def in_order(stream: DataFrame, roles: Roles, folds: Sequence[Fold], late: str = "1 hour", tick: str = "second", idle: int | None = None, reset: str | None = None, warm: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The events of ``stream`` with the folds' columns, each once the watermark, ``late`` behind, has passed it.

    Rows without a key or time are left out.  ``warm``, from :func:`states_of`,
    holds the states that entities start from.  ``buckets`` is part of the state: a
    query that is started again on its checkpoint needs the number it had.  About one for each
    10,000 events that wait at a time is enough.
    """
    stream.sparkSession.conf.set(*STORE)
    columns = list(stream.columns)
    out = _schema(stream, columns, folds)
    known = stream.where(F.col(roles.key).isNotNull() & F.col(roles.time).isNotNull())
    states = _States(folds, roles, columns, reset)
    name = stream.schema[roles.key]
    waiting = StructType([StructField(f.name, ArrayType(f.dataType)) for f in [name, *(f for f in stream.schema if f.name != name.name)]])
    held = StructType([StructField("key", name.dataType), StructField("states", StringType()), StructField("last", LongType())])
    processor = _InOrder(states, waiting, tick, _idle(folds) if idle is None else idle, held)
    bucket = F.pmod(F.xxhash64(roles.key), F.lit(buckets))
    grouped = timed(known, roles, late, tick).withColumn("_bucket", bucket).groupBy("_bucket")
    first = None
    if warm is not None:
        # equal keys hash alike only as one type
        first = warm.select(F.col(roles.key).cast(name.dataType).alias(roles.key), "states", "last").withColumn("_bucket", bucket).groupBy("_bucket")
    return grouped.transformWithStateInPandas(processor, out, "append", "EventTime", first)


def _sorted(df: DataFrame, roles: Roles) -> DataFrame:
    known = df.where(F.col(roles.key).isNotNull() & F.col(roles.time).isNotNull())
    return known.repartition(roles.key).sortWithinPartitions(roles.key, roles.time, roles.id)


def _by_entity(batches: Iterator[pd.DataFrame], columns: Sequence[str], key: int) -> Iterator[tuple[object, bool, list[tuple]]]:
    """Runs of rows of one entity, in order, with whether the entity is new; one entity may be several runs."""
    last: object = None
    for batch in batches:
        run: list[tuple] = []
        fresh = False
        for row in batch[list(columns)].itertuples(index=False, name=None):
            row = tuple(_plain(v) for v in row)
            if row[key] != last or (last is None):
                if run:
                    yield last, fresh, run
                run, fresh, last = [], True, row[key]
            run.append(row)
        if run:
            yield last, fresh, run


def replayed(df: DataFrame, roles: Roles, folds: Sequence[Fold], reset: str | None = None) -> DataFrame:
    """What :func:`in_order` gives for a table: rows stream by in order, one entity's states at a time in memory."""
    columns = list(df.columns)
    states = _States(folds, roles, columns, reset)
    key = columns.index(roles.key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for _, fresh, rows in _by_entity(batches, columns, key):
            held, out = states.take(states.start() if fresh else held, rows)
            yield states.frame(out)

    return _sorted(df, roles).mapInPandas(run, _schema(df, columns, folds))


def states_of(df: DataFrame, roles: Roles, folds: Sequence[Fold], reset: str | None = None) -> DataFrame:
    """``(key, states, last)``: the folds' states after all rows of ``df``, to start a stream from."""
    columns = list(df.columns)
    states = _States(folds, roles, columns, reset)
    key = columns.index(roles.key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        name, last = None, 0
        for at, fresh, rows in _by_entity(batches, columns, key):
            if fresh and name is not None:
                yield pd.DataFrame({roles.key: [name], "states": [json.dumps(held)], "last": [last]})
            held, _ = states.take(states.start() if fresh else held, rows)
            name, last = at, rows[-1][states.time]
        if name is not None:
            yield pd.DataFrame({roles.key: [name], "states": [json.dumps(held)], "last": [last]})

    return _sorted(df, roles).mapInPandas(run, f"`{roles.key}` {dict(df.dtypes)[roles.key]}, states string, last long")
