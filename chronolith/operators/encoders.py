"""Fit once, look up later: target and label encoding, entity statistics, missing patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators.tables import with_position
from chronolith.spec import Roles
from chronolith.windows import recent_count


def category(column: str) -> Column:
    """A column as text, null as ``missing``."""
    return F.coalesce(F.col(column).cast("string"), F.lit("missing"))


def fit_target_encoding(train: DataFrame, column: str, target: str, smoothing: float = 100.0, min_samples: int = 20) -> DataFrame:
    """``(category, value, overall)``: smoothed mean target by category; rare categories get the overall mean."""
    known = train.where(F.col(target).isNotNull())
    overall = known.agg(F.avg(F.col(target).cast("double")).alias("overall"))
    by = known.groupBy(category(column).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("mean"))
    smooth = (F.col("n") * F.col("mean") + F.lit(smoothing) * F.col("overall")) / (F.col("n") + F.lit(smoothing))
    return by.crossJoin(F.broadcast(overall)).select("category", F.when(F.col("n") < min_samples, F.col("overall")).otherwise(smooth).alias("value"), "overall")


def target_encode(df: DataFrame, state: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Look ``column`` up in a fitted state; categories never seen get the overall mean."""
    output = output or f"{column}_te"
    looked = state.select(F.col("category").alias("_category"), F.col("value").alias("_value"))
    overall = state.agg(F.max("overall").alias("_overall"))
    joined = df.withColumn("_key", category(column)).join(looked, F.col("_key") == F.col("_category"), "left").crossJoin(F.broadcast(overall))
    return joined.select(*df.columns, F.coalesce("_value", "_overall").alias(output))


def fit_label_encoding(train: DataFrame, column: str) -> DataFrame:
    """``(category, code)``: sorted distinct categories numbered from 0, in parallel."""
    distinct = train.select(category(column).alias("category")).distinct()
    return with_position(distinct, "category").select("category", F.col("position").cast("int").alias("code"))


def label_encode(df: DataFrame, state: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Codes of a fitted state; -1 for categories never seen."""
    looked = state.select(F.col("category").alias("_category"), F.col("code").alias("_code"))
    joined = df.withColumn("_key", category(column)).join(looked, F.col("_key") == F.col("_category"), "left")
    return joined.select(*df.columns, F.coalesce("_code", F.lit(-1)).alias(output or f"{column}_label"))


def uid_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """Columns as whole numbers (half to even, null and absent as -1) joined by ``_``."""
    parts = [F.bround(F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).cast("long").cast("string") if c in df.columns else F.lit("-1") for c in columns]
    return F.concat_ws("_", *parts)


def fit_uid(train: DataFrame, roles: Roles, columns: Sequence[str]) -> DataFrame:
    """Per entity of the training rows: count, amount statistics, share of rows, last time."""
    total = train.agg(F.count(F.lit(1)).alias("_rows"))
    by = train.groupBy(uid_key(train, columns).alias("uid")).agg(
        F.count(roles.amount).alias("uid_txn_count"), F.avg(roles.amount).alias("uid_amt_mean"), F.stddev_samp(roles.amount).alias("uid_amt_std"), F.min(roles.amount).alias("uid_amt_min"), F.max(roles.amount).alias("uid_amt_max"), F.max(roles.time).alias("uid_last_time"), F.count(F.lit(1)).alias("_n"))
    return by.crossJoin(F.broadcast(total)).select("*", (F.col("_n") / F.col("_rows")).alias("uid_freq")).drop("_n", "_rows")


def uid_features(df: DataFrame, state: DataFrame, roles: Roles, columns: Sequence[str], windows: Sequence[int] = ()) -> DataFrame:
    """Fitted entity statistics, time since the last training row, z-score, and counts of recent rows of this table."""
    keyed = df.withColumn("uid", uid_key(df, columns))
    first = df.agg(F.min(roles.time).alias("_first"))
    looked = state.withColumnRenamed("uid", "_uid")
    joined = keyed.join(looked, F.col("uid") == F.col("_uid"), "left").crossJoin(F.broadcast(first))
    counts = [recent_count(roles, w, "uid").alias(f"uid_txn_count_{w}s") for w in windows]
    spread = F.when(F.col("uid_amt_std") > 0, (F.col(roles.amount) - F.col("uid_amt_mean")) / F.col("uid_amt_std"))
    return joined.select(
        *df.columns,
        "uid",
        F.coalesce("uid_txn_count", F.lit(0)).alias("uid_txn_count"),
        "uid_amt_mean",
        "uid_amt_std",
        "uid_amt_min",
        "uid_amt_max",
        F.coalesce("uid_freq", F.lit(0.0)).alias("uid_freq"),
        F.col("_uid").isNull().cast("int").alias("uid_is_new"),
        F.greatest(F.col(roles.time) - F.coalesce("uid_last_time", "_first"), F.lit(0)).cast("long").alias("uid_time_since_last"),
        F.coalesce(spread, F.lit(0.0)).alias("uid_amt_zscore"),
        *counts,
    )


def fit_missing_pattern(train: DataFrame, columns: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Columns with some but not only nulls, the ``id_`` columns, and all columns; one pass, one row to the driver."""
    columns = list(columns or train.columns)
    rates = train.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return {"flagged": [c for c in columns if rates[c] is not None and 0 < rates[c] < 1], "ids": [c for c in columns if c.startswith("id_")], "all": columns}


def missing_pattern(df: DataFrame, state: dict[str, list[str]]) -> DataFrame:
    """Flags of the fitted columns (0 if absent) and counts of nulls."""

    def nulls(names: Sequence[str]) -> Column:
        return sum((F.col(c).isNull().cast("int") for c in names if c in df.columns), F.lit(0))

    flags = [(F.col(c).isNull().cast("int") if c in df.columns else F.lit(0)).alias(f"{c}_missing_flag") for c in state["flagged"]]
    return df.select("*", *flags, nulls(state["all"]).alias("total_missing_count"), nulls(state["ids"]).alias("id_cols_missing_count"))
