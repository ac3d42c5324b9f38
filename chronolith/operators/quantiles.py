"""Exact quantiles of many columns by distributed selection, without a reducer that holds a column.

A double's bits, turned so that they sort like numbers, are a key of 64 bits.  A
pass counts the next ``BITS`` of the keys of all columns, in the tasks; running
counts tell which buckets hold the wanted ranks, and the next pass counts
inside those only.  Once what the wanted buckets hold is little, its distinct
values are fetched and the ranks read off.  So a column takes two or three passes,
whatever its values and however they are skewed or tied, and what is shuffled is
counts: at most ``2 ** BITS`` rows for a column and wanted bucket.

Quantiles are linear between neighbours, as ``percentile`` gives them; nulls do not
count; NaN is the greatest number; -0.0 is 0.0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
#: Up to this many values in the wanted buckets, they are fetched.
FEW = 20_000


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers that sort like the doubles."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.astype(np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    """The double of a key."""
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counted(df: DataFrame, columns: Sequence[str], wanted: dict[int, np.ndarray] | None, depth: int, bits: int) -> DataFrame:
    """``(col, prefix, n)``: how many values of each column begin with each prefix of ``depth + bits`` bits, below the ``wanted`` prefixes of ``depth`` bits."""
    sent = df.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k in range(len(columns)):
                column = batch.column(k).drop_null()
                key = keys_of(column.to_numpy(zero_copy_only=False))
                if sent is not None:
                    own = sent.value.get(k)
                    if own is None or not len(own):
                        continue
                    top = key >> np.uint64(64 - depth)
                    key = key[np.isin(top, own)]
                if len(key):
                    found, n = np.unique(key >> np.uint64(64 - depth - bits), return_counts=True)
                    parts = held.setdefault(k, [])
                    parts.append((found, n))
                    # as many as there are prefixes at most, not as there are batches
                    if len(parts) == 16:
                        held[k] = [_merged(parts)]
        for k, parts in held.items():
            found, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k), pa.int32()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["col", "prefix", "n"])

    cells = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return cells.mapInArrow(run, "col int, prefix long, n long").groupBy("col", "prefix").agg(F.sum("n").alias("n"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def exact_quantiles(df: DataFrame, columns: Sequence[str], marks: Sequence[float]) -> dict[str, list[float] | None]:
    """The ``marks`` (from 0 to 1) of each column; None for a column without values.

    ``df`` is read once for each pass, so what is dear to make should be written first.
    """
    columns = list(dict.fromkeys(columns))
    if not columns:
        return {}
    spark = df.sparkSession
    depth, bits = 0, BITS
    wanted: dict[int, np.ndarray] | None = None
    totals: dict[int, int] = {}
    targets: list[tuple[int, int, int, int]] = []
    while True:
        counts = _counted(df, columns, wanted, depth, bits)
        depth += bits
        # a long sorts as its unsigned number does once the sign is turned
        order = F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))) if depth == 64 else F.col("prefix")
        parent = F.shiftrightunsigned("prefix", bits) if wanted is not None else F.lit(0).cast("long")
        run = counts.withColumn("parent", parent).withColumn("upto", F.sum("n").over(Window.partitionBy("col", "parent").orderBy(order)))
        if wanted is None:
            # the ranks that the marks lie between, of a column's count
            run = run.withColumn("total", F.sum("n").over(Window.partitionBy("col")))
            places = F.flatten(F.array(*[F.array(F.floor(F.lit(float(p)) * (F.col("total") - 1)), F.ceil(F.lit(float(p)) * (F.col("total") - 1))) for p in marks]))
            asked = run.withColumn("base", F.lit(0).cast("long")).withColumn("rank", F.explode(F.array_distinct(places)))
        else:
            asked = run.withColumn("total", F.lit(0).cast("long")).join(F.broadcast(spark.createDataFrame(targets, "col int, parent long, base long, rank long")), ["col", "parent"])
        first = F.col("base") + F.col("upto") - F.col("n")
        rows = asked.where((F.col("rank") >= first) & (F.col("rank") < first + F.col("n"))).select("col", "rank", "prefix", first.alias("base"), "n", "total").collect()
        if wanted is None:
            totals = {r["col"]: r["total"] for r in rows}
            if not rows:
                return {c: None for c in columns}
        if depth == 64:
            found = {(r["col"], r["rank"]): value_of(r["prefix"] & ((1 << 64) - 1)) for r in rows}
            break
        targets = [(r["col"], r["prefix"], r["base"], r["rank"]) for r in rows]
        wanted = {k: np.unique(np.array([r["prefix"] for r in rows if r["col"] == k], np.int64)).view(np.uint64) for k in totals}
        inside = sum({(r["col"], r["prefix"]): r["n"] for r in rows}.values())
        # all that is left at once, if it is little
        bits = 64 - depth if inside <= FEW else BITS
    out: dict[str, list[float] | None] = {}
    for k, c in enumerate(columns):
        if k not in totals:
            out[c] = None
            continue
        own = []
        for p in marks:
            at = p * (totals[k] - 1)
            low, high = math.floor(at), math.ceil(at)
            a, b = found[k, low], found[k, high]
            own.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
        out[c] = own
    return out


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many different values besides null each column has, for all columns from one scan and one shuffle of values."""
    if not columns:
        return {}
    kinds = {f.name: f.dataType.typeName() for f in df.schema}

    def named(c: str) -> Column:
        x = F.col(f"`{c}`")
        if kinds[c] in ("float", "double"):
            return (x + F.lit(0.0)).cast("string")
        text = F.hex(x) if kinds[c] == "binary" else F.to_json(F.struct(x)) if kinds[c] in ("array", "map", "struct") else x.cast("string")
        # long values go by their digest, which no short one can spell
        return F.when(x.isNotNull(), F.when(F.length(text) > 64, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text))

    cells = F.array(*[F.struct(F.lit(k).alias("col"), named(c).alias("value")) for k, c in enumerate(columns)])
    each = df.select(F.explode(cells).alias("c")).select("c.col", "c.value").where("value is not null").groupBy("col", "value").agg(F.lit(1))
    found = {r["col"]: r["n"] for r in each.groupBy("col").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(k, 0) for k, c in enumerate(columns)}
