"""Streams: reading and parsing events, rules, counts and sequences in the order of event time, and sinks.

What looks back at an entity's events runs in the order of event time
(:mod:`chronolith.streaming.ordered`), so a stream gives the batch result when no event
is later than the watermark; later ones are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronolith.sources.tables import read_list
from chronolith.spec import Roles
from chronolith.storage import exists

#: Microseconds of a tick.
TICKS = {"second": 1_000_000, "millisecond": 1000, "microsecond": 1}
#: Added to event times, about 32 years: a watermark starts at 1970, and events of that time or before would count as late.
SHIFT = 10**15


def read_events(spark, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A stream of Parquet files, in the order in which they were written."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def parse_events(stream: DataFrame, schema: StructType | str, column: str = "value") -> DataFrame:
    """JSON events, one a row, as columns; what can't be parsed is all null."""
    return stream.select(F.from_json(F.col(column).cast("string"), schema).alias("e")).select("e.*")


def timed(stream: DataFrame, roles: Roles, late: str, tick: str) -> DataFrame:
    """``stream`` with its ticks as event time ``_at``, and a watermark on it."""
    at = F.timestamp_micros((F.col(roles.time) * TICKS[tick] + SHIFT).cast("long"))
    return stream.withColumn("_at", at).withWatermark("_at", late)


def velocity_counts(stream: DataFrame, roles: Roles, width: int, keep: Sequence[str] = (), late: str = "1 hour", tick: str = "second", reset: str | None = None, buckets: int | None = None) -> DataFrame:
    """``(id, key, t, *keep, n_recent)``: events of the key in the last ``width`` ticks, this one included.

    An event is counted when the watermark has passed it, in the order of time and
    id, so that events that come late count where they belong.  A row whose
    boolean column ``reset`` is true empties its key's state at its place in
    time, and is no event itself.  ``tick`` is second, millisecond or microsecond; ``buckets``
    is that of :func:`chronolith.streaming.ordered.in_order`.
    """
    from chronolith.streaming import folds, ordered

    columns = [roles.id, roles.key, roles.time, *keep, *([reset] if reset else [])]
    counted = ordered.in_order(stream.select(*columns), roles, [folds.RecentCount(width)], late, tick, reset=reset, buckets=buckets or ordered.BUCKETS)
    return counted.drop(reset) if reset and reset not in keep else counted


def read_state(spark, checkpoint: str, name: str = "held") -> DataFrame:
    """The state that a stopped or running query holds, from its checkpoint: ``(key, value)`` of each entity.

    ``held`` has the folds' states as JSON with the time of the last event, ``waiting`` the events to come.
    """
    state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint).select("list_element.*")
    key = state.columns[0]
    if name == "held":
        return state.select(F.struct(key).alias("key"), F.struct("states", "last").alias("value"))
    events = state.select(F.explode(F.arrays_zip(*state.columns)).alias("list_element"))
    return events.select(F.struct(F.col("list_element")[key].alias(key)).alias("key"), "list_element")


def ruled(batch: DataFrame, history: DataFrame, engine, roles: Roles) -> DataFrame:
    """A micro-batch judged by the rules in order, each counting only what the rules before it let through.

    ``history`` holds the rows of earlier micro-batches with the same columns;
    a rule that looks back sees those of them that it is to count.
    """
    both = batch.withColumn("_new", F.lit(True)).unionByName(history.select(*batch.columns).withColumn("_new", F.lit(False)))
    return engine.evaluate(both, roles).where("_new").drop("_new")


def rule_stream(stream: DataFrame, engine, roles: Roles, sink: str, checkpoint: str, width: int):
    """Judge each micro-batch by rules in order, as soon as it is there, and write it below ``sink``; a replayed batch overwrites itself.

    Earlier rows of the last ``width`` ticks are read back from the sink, which has
    a folder ``slot=`` for each ``width`` ticks, so what is listed and read does not
    grow with the stream's age.  An event that comes late sees what is older than
    itself, but what was judged before it came stays as it was; where that must
    not be, see :func:`rules_in_order`.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = batch.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_action", F.lit(None).cast("string")).schema
        first, last = batch.agg(F.min(roles.time), F.max(roles.time)).first()
        done = spark.createDataFrame([], schema)
        if first is not None:
            slots = [f"{sink}/slot={k}" for k in range((first - width) // width, last // width + 1)]
            if there := [p for p in slots if exists(spark, p)]:
                held = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", sink).parquet(*there)
                done = held.where((F.col(roles.time) >= first - width) & (F.col("batch") != number)).select(*schema.names)
        judged = ruled(batch, done, engine, roles).withColumns({"slot": F.floor(F.col(roles.time) / width), "batch": F.lit(number).cast("long")})
        judged.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("slot", "batch").parquet(sink)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rules_in_order(stream: DataFrame, engine, roles: Roles, late: str = "1 hour", tick: str = "second") -> DataFrame:
    """``stream`` with ``rule`` and ``rule_action``, judged in the order of event time once the watermark has passed an event.

    Blacklists are joined as they are; the rest is one stateful operator by key.
    """
    from chronolith.operators.rules import Blacklist
    from chronolith.streaming import folds, ordered

    columns, listed, joined = stream.columns, {}, stream
    for k, rule in enumerate(engine.rules):
        if isinstance(rule, Blacklist):
            listed[rule.name] = f"_blocked_{k}"
            joined = rule.apply(joined, roles)[0].withColumnRenamed("_blocked", f"_blocked_{k}")
    return ordered.in_order(joined, roles, [folds.Ruled(engine, roles, listed)], late, tick).select(*columns, "rule", "rule_action")


def blocked(stream: DataFrame, column: str, path: str) -> DataFrame:
    """``stream`` with ``is_blocked``: a join with a list that is read anew by each micro-batch."""
    listed = read_list(stream.sparkSession, path).select(F.col("value").alias("_listed"))
    joined = stream.join(listed, F.col(column).cast("string") == F.col("_listed"), "left")
    return joined.withColumn("is_blocked", F.col("_listed").isNotNull()).drop("_listed")


def last_sequences(stream: DataFrame, roles: Roles, features: Sequence[str], length: int = 20, late: str = "1 hour", tick: str = "second", idle: int | None = None) -> DataFrame:
    """``(id, key, t, n, sequence)``: the last ``length`` rows of the key after each event, in the order of event time.

    An entity's ring goes ``idle`` ticks after its last event; without ``idle`` it stays.
    """
    from chronolith.streaming import folds, ordered

    columns = list(dict.fromkeys([roles.id, roles.key, roles.time, *features]))
    found = ordered.in_order(stream.select(*columns), roles, [folds.LastRows(features, length)], late, tick, idle)
    return found.select(roles.id, roles.key, roles.time, "n", "sequence")


def score_stream(stream: DataFrame, score, sink: str, checkpoint: str):
    """Score each micro-batch with ``score(df)`` and append it to a Parquet table; a replayed batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_totals(stream: DataFrame, timestamp: str, keys: Sequence[str], amount: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by time window and key, with a watermark."""
    return stream.withWatermark(timestamp, late).groupBy(F.window(timestamp, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
