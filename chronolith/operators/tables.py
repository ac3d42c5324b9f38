"""Joins, splits and alignment of whole tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_side_table(df: DataFrame, side: DataFrame, key: str, side_key: str | None = None) -> DataFrame:
    """Left join with a table of at most one row for each key."""
    side_key = side_key or key
    return df.join(side, df[key] == side[side_key], "left").drop(*([side[side_key]] if side_key == key else []))


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from 0 in a global order, in parallel.

    Rows are dealt by ranges and numbered inside them; the counts of the ranges
    before, one number each, are added.
    """
    from chronolith.storage import written

    dealt = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_local")).cast("long").alias("position"))


def time_split(df: DataFrame, order: Sequence[str], ratio: float) -> DataFrame:
    """``is_val``: true for the last ``int(n * ratio)`` rows in order."""
    numbered = with_position(df, *order)
    n = numbered.agg(F.count(F.lit(1)).alias("_rows"))
    cut = F.col("_rows") - F.floor(F.col("_rows") * F.lit(ratio))
    return numbered.crossJoin(F.broadcast(n)).select(*df.columns, (F.col("position") >= cut).alias("is_val"))


def purged_folds(df: DataFrame, order: Sequence[str], n_splits: int = 5, purge: int = 0, min_train: int = 0) -> DataFrame:
    """Rows of expanding time folds as ``(fold, is_val)`` beside each row that a fold uses.

    A fold trains on all rows before its block and validates on the block, less
    ``purge`` rows at its start; folds that are empty or too small are left out.
    """
    numbered = with_position(df, *order)
    n = numbered.agg(F.count(F.lit(1)).alias("_rows"))
    size = F.floor(F.col("_rows") / (n_splits + 1))
    folds = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    rows = numbered.crossJoin(F.broadcast(n)).select("*", folds)
    train_end, val_start = size * F.col("fold"), size * F.col("fold") + purge
    val_end = F.when(F.col("fold") == n_splits, F.col("_rows")).otherwise(size * (F.col("fold") + 1))
    is_val = (F.col("position") >= val_start) & (F.col("position") < val_end)
    used = rows.where((F.col("position") < train_end) | is_val).where((train_end >= max(1, min_train)) & (val_start < val_end))
    return used.select(*df.columns, "fold", is_val.alias("is_val"))


def align(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly ``columns``, in order; absent ones are ``fill``, others go."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error that lists the absent columns."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df


def sample_rows(df: DataFrame, n: int, id: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, the same ones each time."""
    return df.orderBy(F.xxhash64(id, F.lit(seed)), id).limit(n)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """``old`` with the rows of ``new``; for keys in both, the new row if ``replace``, else the old."""
    if replace:
        return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def set_operations(a: DataFrame, b: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """Union, intersection and difference of two row sets, each row once."""
    yield "union", a.unionByName(b).distinct()
    yield "intersection", a.intersect(b)
    yield "difference", a.exceptAll(b).distinct()
