"""Readers and writers: CSV, Parquet, text lists, scores and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructType

SUFFIXES = {".parquet": "parquet", ".pq": "parquet", ".csv": "csv", ".txt": "csv", ".json": "json", ".orc": "orc"}


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, format: str | None = None) -> DataFrame:
    """A table by its suffix; other suffixes need ``format``.  Give CSV a schema: without one it is inferred in an extra pass."""
    kind = format or next((f for s, f in SUFFIXES.items() if path.rstrip("/").endswith(s)), None)
    if kind is None:
        raise ValueError(f"can't tell the format of {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    return reader.format(kind).load(path)


def load_pair(spark: SparkSession, folder: str, name: str, format: str = "parquet", schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The event and side tables ``{name}_transaction`` and ``{name}_identity``."""
    return tuple(read(spark, f"{folder}/{name}_{part}.{format}", schema, format) for part in ("transaction", "identity"))


def save_schema(df: DataFrame) -> str:
    """The schema as JSON, to be applied to later tables."""
    return df.schema.json()


def apply_schema(df: DataFrame, schema: str) -> DataFrame:
    """Cast the columns that both have; a value that can't be cast becomes null."""
    types = {f.name: f.dataType for f in StructType.fromJson(json.loads(schema))}
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def fitted_types(df: DataFrame) -> StructType:
    """The schema with whole numbers in the smallest type that holds their range, and ``id_`` columns as text."""
    whole = [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in whole], *[F.max(c).alias(f"hi_{c}") for c in whole]).first() if whole else None
    out = StructType()
    for f in df.schema:
        kind = f.dataType
        if f.name.startswith("id_"):
            kind = StringType()
        elif f.name in whole and row[f"lo_{f.name}"] is not None:
            low, high = row[f"lo_{f.name}"], row[f"hi_{f.name}"]
            kind = next(t() for t, bits in ((ByteType, 7), (ShortType, 15), (IntegerType, 31), (LongType, 63)) if -(1 << bits) <= low and high < (1 << bits))
        out = out.add(f.name, kind)
    return out


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: one entry a line; blank lines and ``#`` comments are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#")).distinct()


def write(df: DataFrame, path: str, format: str | None = None, mode: str = "overwrite") -> None:
    """A table by its suffix."""
    kind = format or next((f for s, f in SUFFIXES.items() if path.endswith(s)), "parquet")
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if kind == "csv" else writer.format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_scores(df: DataFrame, url: str | None = None, table: str = "scores", path: str | None = None, properties: dict | None = None) -> None:
    """Append scores to a database table by JDBC, or to a Parquet table."""
    if url:
        df.write.jdbc(url, table, mode="append", properties=properties or {})
    else:
        df.write.mode("append").parquet(path)

