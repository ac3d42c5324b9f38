"""Cleaning fitted on training rows, and profiles of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.quantiles import distinct_counts, exact_quantiles

NUMERIC = ("byte", "short", "integer", "long", "float", "double")
#: Columns in one aggregation.
CHUNK = 64


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if (f.dataType.typeName() in NUMERIC or f.dataType.typeName().startswith("decimal")) and f.name not in exclude]


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one value besides null; least and greatest tell, without counting distinct values."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


@dataclass
class CleanerState:
    constant: list[str]
    stats: dict[str, dict[str, float | None]] = field(default_factory=dict)


def fit_cleaner(train: DataFrame, exclude: Sequence[str] = (), approximate: bool = False) -> CleanerState:
    """Constant columns; per numeric column the median, the 1 % and 99 % quantiles, and whether nulls occur.

    Ids, keys and time belong in ``exclude``.  Quantiles are exact (linear) unless
    ``approximate``, which bounds memory for very many distinct values.
    """
    columns = [c for c in train.columns if c not in exclude]
    state = CleanerState(constant_columns(train, columns))
    numeric = [c for c in numeric_columns(train, exclude) if c not in state.constant]
    marks = [0.01, 0.5, 0.99]
    exact = {} if approximate else exact_quantiles(train, numeric, marks)
    for at in range(0, len(numeric), CHUNK):
        some = numeric[at : at + CHUNK]
        sketched = [F.percentile_approx(c, F.array(*[F.lit(m) for m in marks])).alias(f"q_{c}") for c in some] if approximate else []
        row = train.agg(*[F.max(F.col(c).isNull()).alias(f"n_{c}") for c in some], *sketched).first()
        for c in some:
            q = (row[f"q_{c}"] if approximate else exact[c]) or [None] * 3
            state.stats[c] = {"q01": q[0], "median": q[1], "q99": q[2], "has_missing": bool(row[f"n_{c}"])}
    return state


def clean(df: DataFrame, state: CleanerState) -> DataFrame:
    """Drop constants, flag nulls and outliers, fill with the median, clip to the quantiles."""
    out = []
    for c in df.columns:
        if c in state.constant:
            continue
        s = state.stats.get(c)
        if not s or s["median"] is None:
            out.append(F.col(c))
            continue
        low, high = F.lit(float(s["q01"])), F.lit(float(s["q99"]))
        filled = F.coalesce(F.col(c).cast("double"), F.lit(float(s["median"])))
        out.append(F.least(F.greatest(filled, low), high).alias(c))
        if s["has_missing"]:
            out.append(F.col(c).isNull().cast("int").alias(f"{c}_isna"))
        out += [F.coalesce(F.col(c) < low, F.lit(False)).cast("int").alias(f"{c}_clip_low"), F.coalesce(F.col(c) > high, F.lit(False)).cast("int").alias(f"{c}_clip_high")]
    return df.select(*out)


def cleaning_summary(train: DataFrame, state: CleanerState) -> DataFrame:
    """What is done to each column, and why."""
    rows = [(c, "drop", "constant", None, None, None, None) for c in state.constant]
    rows += [(c, "clean", "numeric", float(s["median"]), float(s["q01"]), float(s["q99"]), s["has_missing"]) for c, s in state.stats.items() if s["median"] is not None]
    return train.sparkSession.createDataFrame(rows, "column string, action string, reason string, median double, q1 double, q99 double, has_missing boolean")


def profile(df: DataFrame) -> DataFrame:
    """One row a column: type, missing rate, distinct values (null counts as one), and numeric statistics."""
    numeric = numeric_columns(df)
    quartiles, distinct, rows = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]), distinct_counts(df, df.columns), []
    for at in range(0, len(df.columns), CHUNK):
        fields = df.schema.fields[at : at + CHUNK]
        columns = []
        for f in fields:
            x = F.col(f"`{f.name}`")
            number = x.cast("double") if f.name in numeric else F.lit(None).cast("double")
            columns.append(F.struct(F.round(F.avg(x.isNull().cast("double")), 4).alias("missing"), F.max(x.isNull().cast("int")).alias("none"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"), F.min(number).alias("min"), F.max(number).alias("max")))
        found = df.agg(F.array(*columns).alias("r")).first()["r"]
        rows += [(f.name, f.dataType.simpleString(), r["missing"], distinct[f.name] + (r["none"] or 0), r["mean"], r["std"], r["min"], r["max"], *(quartiles.get(f.name) or [None] * 3)) for f, r in zip(fields, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, missing_rate double, unique_count long, mean double, std double, min double, max double, q25 double, q50 double, q75 double")


def feature_stats(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """Missing rate, distinct values, mean, population deviation, range, median and 95 % quantile of numeric columns.

    With a ``target``, also ``iv_score``, the information value.
    """
    columns = list(columns or numeric_columns(df))
    marks, distinct = exact_quantiles(df, columns, [0.5, 0.95]), distinct_counts(df, columns)
    structs = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).isNull().cast("double")).alias("missing_rate"), F.lit(distinct[c]).cast("long").alias("n_unique"), F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("std"), F.min(F.col(c).cast("double")).alias("min_value"), F.max(F.col(c).cast("double")).alias("max_value"), *[F.lit(x).cast("double").alias(n) for n, x in zip(("p50", "p95"), marks[c] or (None, None), strict=True)]) for c in columns]
    found = df.agg(F.array(*structs).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    if target is None:
        return found
    from chronolith.operators.binning import information_values

    iv = information_values(df, columns, target).select(F.col("feature").alias("_feature"), F.col("iv").alias("iv_score"))
    return found.join(iv, F.col("feature") == F.col("_feature"), "left").drop("_feature")
