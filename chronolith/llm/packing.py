"""Packing into length buckets that minimise padding.

A global histogram of lengths, one row per length, goes to the driver; dynamic
programming over it finds the ``buckets`` upper bounds with the least padding.
Documents are then numbered inside their bucket, in parallel, and every
``budget // bound`` of them form a batch whose padded size keeps to the token
budget.

The histogram is exact at every size.  ``h`` different lengths need ``h * h / 2``
tokens at least, so it has at most the square root of twice the corpus's tokens
as rows, 16 bytes each, and no more than the longest document has tokens.
Nothing is cut or dropped: a document longer than the budget is a batch alone.
Rows of length 0 form a bucket of bound 0 in batches of ``budget`` rows.  Rows
that repeat are packed each, and a null id like any other; a null length counts
as 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.storage import shuffle_partitions, written


def least_of_ranges(cost: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, price) -> tuple[np.ndarray, np.ndarray]:
    """For each right end ``at``, the least total over split points ``first`` to ``last``, and the first such point."""
    sizes = last - first + 1
    begins = np.cumsum(sizes) - sizes
    options = np.arange(int(sizes.sum())) + np.repeat(first - begins, sizes)
    totals = cost[options] + price(options, np.repeat(at, sizes))
    least = np.minimum.reduceat(totals, begins)
    hits = np.flatnonzero(totals == np.repeat(least, sizes))
    return least, options[hits[np.searchsorted(hits, begins)]]


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds, at most ``buckets``, with the least total padding.

    The best split point moves with the right end, so each layer halves the
    right ends and looks between the neighbours' split points: O(h log h).
    """
    h = len(lengths)
    if not h:
        return []
    lengths = lengths.astype(np.int64)
    n, total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    upper = np.concatenate([[0], lengths])

    def price(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The padding of the lengths numbered i to j - 1, in one bucket."""
        return upper[j] * (n[j] - n[i]) - (total[j] - total[i])

    cost = price(np.zeros(h + 1, np.int64), np.arange(h + 1))
    back: list[np.ndarray] = []
    for _ in range(1, min(buckets, h)):
        new, split = cost.copy(), np.zeros(h + 1, np.int64)
        # right ends known so far, in order, with their split points; the outer two bound all
        step = 1 << (h.bit_length() - 1)
        while step:
            at = np.arange(step, h + 1, 2 * step)
            first = split[at - step]
            after = at + step
            last = np.minimum(np.where(after <= h, split[np.minimum(after, h)], h), at - 1)
            new[at], split[at] = least_of_ranges(cost, at, np.minimum(first, last), last, price)
            step //= 2
        back.append(split)
        cost = new
    bounds, at = [], h
    for split in reversed(back):
        bounds.append(int(lengths[at - 1]))
        at = int(split[at])
        if not at:
            break
    if at:
        bounds.append(int(lengths[at - 1]))
    return sorted(bounds)


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """``(doc_id, length, bucket, bound, batch, slot, padding)`` of every row of ``docs``.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the rows of a
    batch; ``padding`` is what the row wastes.
    """
    spark = docs.sparkSession
    rows = written(docs.select("doc_id", F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("length")), "lengths")
    histogram = rows.groupBy("length").count().orderBy("length").toArrow()
    bounds = best_bounds(histogram.column("length").to_numpy(), histogram.column("count").to_numpy(), buckets) or [0]
    listed = F.array(*[F.lit(b).cast("long") for b in bounds])
    over = F.filter(listed, lambda b: b >= F.col("length"))
    placed = rows.withColumn("bound", F.element_at(over, 1)).withColumn("bucket", (F.lit(len(bounds)) - F.size(over)).cast("int"))
    # a bucket may hold most rows: number them in parts that grow in number with the table
    parts = 8 * shuffle_partitions(spark)
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "length"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "length")) - 1
    place = F.col("before") + F.col("local")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1))).cast("long"))
    numbered = dealt.withColumn("local", local).join(before, ["bucket", "part"])
    return numbered.select("doc_id", "length", "bucket", "bound", F.floor(place / per_batch).cast("long").alias("batch"), F.pmod(place, per_batch).cast("long").alias("slot"), (F.col("bound") - F.col("length")).alias("padding"))
