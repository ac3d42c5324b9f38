"""Feature selection and drift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators import binning, metrics
from chronolith.operators.cleaning import numeric_columns
from chronolith.operators.tables import sample_rows


def assembled(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    """``df`` with ``columns`` as one vector, null as 0."""
    safe = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x_{k}") for k, c in enumerate(columns)])
    return VectorAssembler(inputCols=[f"_x_{k}" for k in range(len(columns))], outputCol=output).transform(safe).drop(*[f"_x_{k}" for k in range(len(columns))])


def select_by_iv(df: DataFrame, target: str, threshold: float = 0.02, n_bins: int = 10, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric columns with an information value of ``threshold`` or more; the IV table goes along."""
    columns = [c for c in numeric_columns(df, [*exclude, target])]
    table = binning.information_values(df, columns, target, n_bins)
    return table, [r["feature"] for r in table.where(F.col("iv") >= threshold).collect()]


def correlation(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The correlation matrix, computed on Spark; a square of the number of columns reaches the driver."""
    matrix = Correlation.corr(assembled(df, columns).select("features"), "features").first()[0].toArray()
    return np.nan_to_num(matrix, nan=0.0) + np.diag(np.isnan(np.diag(matrix)).astype(float))


def vif_of(matrix: np.ndarray) -> np.ndarray:
    """Variance inflation of each column: the diagonal of the inverse; infinite for a column the others give exactly."""
    n = len(matrix)
    out = np.empty(n)
    for k in range(n):
        others = [j for j in range(n) if j != k]
        r2 = float(matrix[k, others] @ np.linalg.pinv(matrix[np.ix_(others, others)], hermitian=True) @ matrix[others, k]) if others else 0.0
        out[k] = np.inf if r2 >= 1 - 1e-10 else 1 / (1 - r2)
    return out


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, vif)``."""
    values = vif_of(correlation(df, columns))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, values, strict=True)], "feature string, vif double")


def filter_by_vif(df: DataFrame, columns: Sequence[str], threshold: float = 10.0, iv: dict[str, float] | None = None) -> tuple[list[str], list[tuple[str, float]]]:
    """Columns left, and those dropped with their VIF: infinite ones first, lowest IV first, one a round."""
    left, matrix, dropped = list(columns), correlation(df, columns), []
    while len(left) > 1:
        values = vif_of(matrix)
        over = [k for k, v in enumerate(values) if v > threshold]
        if not over:
            break
        infinite = [k for k in over if np.isinf(values[k])] or over
        worst = min(infinite, key=lambda k: ((iv or {}).get(left[k], 0.0), -values[k], left[k]))
        dropped.append((left[worst], float(values[worst])))
        left.pop(worst)
        matrix = np.delete(np.delete(matrix, worst, 0), worst, 1)
    return left, dropped


def adversarial_validation(train: DataFrame, current: DataFrame, columns: Sequence[str], id: str, threshold: float = 0.7, top: int = 10, rows: int = 50_000, permute: bool = False, repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """Can a linear model tell the two tables apart?  ``(auc, shifted)`` and the telling features.

    A sampling operator: at most ``rows`` rows of each side, drawn by a hash of the id.
    """
    sides = [sample_rows(df, rows, id).select(id, *columns, F.lit(k).alias("_side")) for k, df in enumerate((train, current))]
    both = assembled(sides[0].unionByName(sides[1]), columns, "_raw")
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(both).transform(both).cache()
    model = LogisticRegression(labelCol="_side", regParam=1e-4).fit(scaled)

    def auc(df: DataFrame) -> float:
        scored = model.transform(df).select("_side", vector_to_array("probability")[1].alias("_p"))
        return metrics.roc_auc(scored, "_p", "_side").first()[0] or 0.5

    base = auc(scaled)
    weights = np.abs(model.coefficients.toArray())
    if permute:
        # the mean drop of the AUC over some seeded permutations of each column
        weights = np.array([np.mean([base - auc(_shuffled(scaled, k, seed)) for seed in range(repeats)]) for k in range(len(columns))])
    spark = train.sparkSession
    order = np.argsort(-weights, kind="stable")[:top]
    found = spark.createDataFrame([(columns[int(k)], float(weights[int(k)])) for k in order], "feature string, importance double")
    scaled.unpersist()
    return spark.createDataFrame([(float(base), bool(base > threshold))], "auc double, shifted boolean"), found


def _shuffled(df: DataFrame, column: int, seed: int) -> DataFrame:
    """``df`` with one entry of the vector dealt anew in a seeded order (of the bounded sample)."""
    from pyspark.ml.functions import array_to_vector

    values = df.select(vector_to_array("features").alias("_v"), "_side", F.row_number().over(Window.orderBy(F.xxhash64("features", "_side"))).alias("_k"))
    other = values.select(F.col("_v")[column].alias("_w"), F.row_number().over(Window.orderBy(F.xxhash64("_v", F.lit(7 + seed)))).alias("_k"))
    swapped = F.transform("_v", lambda x, k: F.when(k == column, F.col("_w")).otherwise(x))
    return values.join(other, "_k").select(array_to_vector(swapped).alias("features"), "_side")


def drift(train: DataFrame, current: DataFrame, columns: Sequence[str], id: str, psi: float = 0.25, auc: float = 0.7, n_bins: int = 10) -> DataFrame:
    """``(feature, psi, by_psi, by_model)``: features that drifted by stability or, if the tables can be told apart, by the model."""
    stability = binning.stability(train, current, columns, n_bins, psi)
    verdict, telling = adversarial_validation(train, current, columns, id, auc)
    shifted = verdict.select("shifted")
    named = telling.crossJoin(F.broadcast(shifted)).select(F.col("feature").alias("_f"), F.col("shifted").alias("by_model"))
    joined = stability.join(named, F.col("feature") == F.col("_f"), "left")
    return joined.select("feature", "psi", F.col("drifted").alias("by_psi"), F.coalesce("by_model", F.lit(False)).alias("by_model"))
