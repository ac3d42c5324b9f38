"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolith.storage import written

#: Fixed value: what the contracts call white space, for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column | str, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder`` modulo 5; null ids are not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str | StructType, slice_bytes: int = 3 << 20) -> DataFrame:
    """Run ``function`` over Arrow batches cut to about ``slice_bytes``; it yields columns by name.

    The cut bounds a task's memory by the longest single row, not by the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, slice_bytes):
                for columns in function(piece):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def cut(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``slice_bytes`` each, of one row at least."""
    if batch.nbytes <= slice_bytes or batch.num_rows < 2:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from cut(batch.slice(0, half), slice_bytes)
    yield from cut(batch.slice(half), slice_bytes)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def by_ids(docs: DataFrame, ids: DataFrame, how: str, most: int = 2_000_000) -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the ids of a table ``(doc_id)``.

    The ids are counted first: up to ``most`` of them are broadcast, so that the
    texts stay where they are; more are joined by a shuffle.
    """
    listed = ids.select(F.col("doc_id").alias("chronolith_id"))
    if listed.count() <= most:
        listed = F.broadcast(listed)
    return docs.join(listed, docs["doc_id"] == listed["chronolith_id"], how)


def number_in_groups(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, the row's number from 0 within its group, in parallel whatever a group's size.

    Rows are dealt by ranges of (groups, order) and counted there; a group that
    spans ranges adds the counts of the ranges before.  Groups must not be null;
    nulls of ``order`` come first, and rows that tie are numbered in any order.
    """
    dealt = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    at = dealt.select("*", F.spark_partition_id().alias("chronolith_part"), F.monotonically_increasing_id().alias("chronolith_at"))
    at = written(at, name)
    sizes = at.groupBy("chronolith_part", *groups).agg(F.count(F.lit(1)).alias("chronolith_n"), F.min("chronolith_at").alias("chronolith_first"))
    before = F.coalesce(F.sum("chronolith_n").over(Window.partitionBy(*groups).orderBy("chronolith_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("chronolith_part", *groups, (before - F.col("chronolith_first")).alias("chronolith_shift"))
    return at.join(starts, ["chronolith_part", *groups]).select(*df.columns, (F.col("chronolith_at") + F.col("chronolith_shift")).alias("pos"))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """``rows`` left-joined with a ``table`` of one row a key, where any key of ``rows`` may be hot.

    Keys that more than one in ``most`` of the rows have, ``most`` of them at the
    utmost, meet the rows by broadcast; the others by a shuffle, in which no key
    has more rows than that.  ``rows`` is read twice, so it should be a written table.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("chronolith_n"))
    total = rows.count()
    hot = written(counts.where(F.col("chronolith_n") * most > F.lit(total)).where(F.col("chronolith_n") > most).select(*keys), "hot-keys")
    if hot.isEmpty():
        return rows.join(table, keys, "left")
    held = F.broadcast(written(table.join(F.broadcast(hot), keys, "left_semi"), "hot-rows"))
    columns = [*rows.columns, *[c for c in table.columns if c not in keys]]
    often = rows.join(F.broadcast(hot), keys, "left_semi").join(held, keys, "left")
    rare = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left")
    return often.select(*columns).unionByName(rare.select(*columns))


def scanned(df: DataFrame, key: str, at: str, names: dict[str, str], reduce: Callable[[Column], Column], join: Callable[[Column, Column], Column], descending: bool = False, width: int = 1024) -> DataFrame:
    """``df`` with running aggregates along ``at`` (whole numbers) within ``key``, the row itself included.

    ``names`` gives each result's column, ``reduce`` is the aggregate (of whole
    numbers, 0 being nothing) and ``join`` adds two of its values.  A key's rows
    are scanned in stretches of ``width`` numbers and what the stretches before
    hold is added, so a long key is many tasks.  ``df`` is read twice.
    """
    stretch = F.floor(F.col(at) / width)
    order = F.col("chronolith_stretch").desc() if descending else F.col("chronolith_stretch")
    whole = df.groupBy(key, stretch.alias("chronolith_stretch")).agg(*[reduce(F.col(c)).alias(f"chronolith_{n}") for n, c in names.items()])
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(key, "chronolith_stretch", *[reduce(F.col(f"chronolith_{n}")).over(earlier).alias(f"chronolith_{n}") for n in names])
    inside = Window.partitionBy(key, "chronolith_stretch").orderBy(F.col(at).desc() if descending else F.col(at)).rowsBetween(Window.unboundedPreceding, 0)
    near = df.withColumn("chronolith_stretch", stretch).select("*", *[reduce(F.col(c)).over(inside).alias(n) for n, c in names.items()])
    met = near.join(before, [key, "chronolith_stretch"])
    return met.select(*df.columns, *[join(F.col(n), F.coalesce(F.col(f"chronolith_{n}"), F.lit(0))).alias(n) for n in names])
