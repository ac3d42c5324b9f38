"""Windows over keys with more rows than one task should have.

Keys with more than ``HOT`` rows are found by a count; the others go the plain
way.  A hot key's rows are numbered in order by range partitions, so neither their
number nor ties on time matter, and cut to segments of ``SEGMENT`` rows.  What a
segment needs of the ones before it is small: sums, extremes, and the last two
rows.  Those are carried along a key's segments, one row each, and join the
segment by key and number, of which no task has more than a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.spec import Roles
from chronolith.storage import written

#: Rows of a key above which it is cut.
HOT = 5_000_000
#: Rows of a segment.
SEGMENT = 500_000


def apart(df: DataFrame, keys: Sequence[str], most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the hot keys, and their rows, or None if there are none; rows without a key are never hot.

    At most the rows divided by ``most`` keys are hot, so their list is small.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    hot = df.where(known).groupBy(*keys).count().where(F.col("count") > (HOT if most is None else most)).select(*keys)
    listed = hot.collect()
    if not listed:
        return df, None
    names = F.broadcast(df.sparkSession.createDataFrame(listed, hot.schema))
    return df.join(names, list(keys), "left_anti").select(*df.columns), df.join(names, list(keys), "left_semi").select(*df.columns)


def segmented(df: DataFrame, keys: Sequence[str], time: str, id: str, size: int | None = None) -> DataFrame:
    """``df`` with ``_seg``, the number of the segment within its key, written."""
    dealt = df.repartitionByRange(*keys, time, id).sortWithinPartitions(*keys, time, id)
    at = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "hot-rows")
    sizes = at.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", *keys, (before - F.col("_first")).alias("_shift"))
    seg = F.floor((F.col("_at") + F.col("_shift")) / F.lit(SEGMENT if size is None else size)).cast("long")
    return written(at.join(starts, ["_part", *keys]).select(*df.columns, seg.alias("_seg")), "segments")


def looking_back(rows: DataFrame, keys: Sequence[str], time: str, id: str) -> DataFrame:
    """Segments with the last two rows before them, for which ``_own`` is false."""
    last = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(F.desc(time), F.desc(id)))
    whole = F.struct(*[c for c in rows.columns if c not in ("_seg", *keys)])
    tails = rows.withColumn("_k", last).where("_k <= 2").groupBy(*keys, "_seg").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_k")).alias("k"), whole.alias("row")))), lambda x: x["row"]).alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_seg")
    empty = F.slice("_tail", 1, 0)
    # every segment has a row, so the two segments before hold the two rows before
    both = F.concat(F.coalesce(F.lag("_tail", 2).over(order), empty), F.coalesce(F.lag("_tail", 1).over(order), empty))
    before = tails.select(*keys, "_seg", both.alias("_both"))
    carried = before.select(*keys, "_seg", F.explode(F.slice("_both", F.greatest(F.size("_both") - 1, F.lit(1)), F.lit(2))).alias("row"))
    return rows.withColumn("_own", F.lit(True)).unionByName(carried.select(*keys, "_seg", "row.*").withColumn("_own", F.lit(False)))


def by_segment(rows: DataFrame, roles: Roles, make: Callable[[DataFrame, Roles], DataFrame]) -> DataFrame:
    """``make`` on each segment with the two rows before it; for what depends on no more than those."""
    parted = looking_back(rows, [roles.key], roles.time, roles.id).withColumn("_part", F.struct(F.col(roles.key).alias("k"), F.col("_seg").alias("s")))
    return make(parted, replace(roles, key="_part")).where("_own").drop("_own", "_part")


def expanding(rows: DataFrame, keys: Sequence[str], time: str, id: str, column: str) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with helper columns, and expressions over them for the rows before: count, known, sum, mean, std, min, max.

    Counts and sums add up; squared deviations of two parts are joined by their
    means (Chan, Golub and LeVeque, 1979), each part's taken around its own.
    """
    x = F.col(column).cast("double")
    parts = rows.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("n"), F.count(x).alias("k"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    everything, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    centred = parts.withColumn("c", F.coalesce(F.sum("s").over(everything) / F.sum("k").over(everything), F.lit(0.0)))
    spread = F.when(F.col("k") > 0, F.col("q") + F.col("k") * (F.col("s") / F.col("k") - F.col("c")) * (F.col("s") / F.col("k") - F.col("c"))).otherwise(0.0)
    zero = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0))
    before = centred.withColumn("w", spread).select(*keys, "_seg", zero("n").alias("_bn"), zero("k").alias("_bk"), zero("s").alias("_bs"), zero("w").alias("_bw"), F.min("lo").over(earlier).alias("_blo"), F.max("hi").over(earlier).alias("_bhi"), F.col("c").alias("_c"))
    local = Window.partitionBy(*keys, "_seg").orderBy(time, id).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.select("*", F.count(F.lit(1)).over(local).alias("_ln"), F.count(x).over(local).alias("_lk"), F.coalesce(F.sum(x).over(local), F.lit(0.0)).alias("_ls"), F.coalesce(F.var_pop(x).over(local), F.lit(0.0)).alias("_lv"), F.min(x).over(local).alias("_llo"), F.max(x).over(local).alias("_lhi"))
    met = near.join(before, [*keys, "_seg"])
    n, known, total = F.col("_bn") + F.col("_ln"), F.col("_bk") + F.col("_lk"), F.col("_bs") + F.col("_ls")
    mean_b, mean_l = F.try_divide("_bs", "_bk"), F.try_divide("_ls", "_lk")
    squares_b = F.when(F.col("_bk") > 0, F.greatest(F.col("_bw") - F.col("_bk") * (mean_b - F.col("_c")) * (mean_b - F.col("_c")), F.lit(0.0))).otherwise(0.0)
    apart_ = F.when((F.col("_bk") > 0) & (F.col("_lk") > 0), (mean_l - mean_b) * (mean_l - mean_b) * F.col("_bk") * F.col("_lk") / known).otherwise(0.0)
    squares = squares_b + F.col("_lv") * F.col("_lk") + apart_
    return met, {
        "count": n.cast("long"),
        "known": known,
        "sum": total,
        "mean": F.when(n > 0, total / n).otherwise(0.0),
        "std": F.when(known > 1, F.sqrt(squares / (known - 1))).otherwise(0.0),
        "min": F.coalesce(F.least("_blo", "_llo"), F.lit(0.0)),
        "max": F.coalesce(F.greatest("_bhi", "_lhi"), F.lit(0.0)),
    }
