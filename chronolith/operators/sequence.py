"""Per-entity sequences of the last rows, their embedding, and how unusual they are.

The encoder is linear: principal components of the padded sequence.  A linear
autoencoder's best subspace is theirs (Baldi and Hornik, 1989), so this stands
in for recurrent and convolutional encoders and is marked as a substitution.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.spec import Roles


def sequence_tail(df: DataFrame, roles: Roles, features: Sequence[str], length: int = 20) -> DataFrame:
    """``(key, n, sequence)``: the last ``length`` rows in time order, null features as 0; rows without a key are left out."""
    last = F.row_number().over(Window.partitionBy(roles.key).orderBy(F.desc(roles.time), F.desc(roles.id)))
    rows = df.where(F.col(roles.key).isNotNull()).withColumn("_k", last).where(F.col("_k") <= length)
    step = F.struct(F.col(roles.time).alias("t"), F.col(roles.id).alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    listed = F.sort_array(F.collect_list(step))
    return rows.groupBy(roles.key).agg(F.count(F.lit(1)).cast("int").alias("n"), F.transform(listed, lambda s: s["x"]).alias("sequence"))


def padded(df: DataFrame, width: int, length: int) -> DataFrame:
    """``df`` with the sequence as one flat array of ``length * width``, zeros at the end."""
    flat = F.flatten("sequence")
    return df.withColumn("flat", F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(length * width) - F.size(flat))))


@dataclass
class SequenceEncoder:
    """A fitted linear encoder: mean, scale and components, small enough for every task."""

    features: list[str]
    length: int
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray

    def transform(self, df: DataFrame, roles: Roles) -> DataFrame:
        """``(key, n, embedding, anomaly)``: anomaly is the mean squared error of the known entries."""
        rows = padded(sequence_tail(df, roles, self.features, self.length), len(self.features), self.length)
        centred = F.zip_with("flat", F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(self.mean, self.scale, strict=True)]), lambda x, p: (x - p["m"]) * p["s"])
        dot = lambda weights, x: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = rows.withColumn("z", centred).withColumn("embedding", F.array(*[dot(c, F.col("z")) for c in self.components]))
        back = F.array(*[dot(w, F.col("embedding")) for w in self.components.T])
        errors = F.slice(F.zip_with("z", back, lambda a, b: (a - b) * (a - b)), F.lit(1), F.col("n") * len(self.features))
        anomaly = F.aggregate(errors, F.lit(0.0), lambda s, e: s + e) / (F.col("n") * len(self.features))
        return out.select(roles.key, "n", F.transform("embedding", lambda v: v.cast("float")).alias("embedding"), anomaly.alias("anomaly"))


    def save(self, path: str) -> None:
        """Write the encoder as one JSON text below ``path``."""
        value = {"features": self.features, "length": self.length, "mean": self.mean.tolist(), "scale": self.scale.tolist(), "components": self.components.tolist()}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SequenceEncoder:
        value = json.loads(spark.read.text(path).first()[0])
        return SequenceEncoder(value["features"], value["length"], *[np.array(value[k]) for k in ("mean", "scale", "components")])


def fit_encoder(df: DataFrame, roles: Roles, features: Sequence[str], length: int = 20, size: int = 8) -> SequenceEncoder:
    """Fit the encoder on the sequences of ``df``."""
    width = length * len(features)
    rows = padded(sequence_tail(df, roles, features, length), len(features), length).select(array_to_vector("flat").alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows)
    model = PCA(k=min(size, width), inputCol="scaled", outputCol="e").fit(scaler.transform(rows))
    std = scaler.std.toArray()
    return SequenceEncoder(list(features), length, scaler.mean.toArray(), np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0), model.pc.toArray().T)


def join_embedding(df: DataFrame, embedded: DataFrame, key: str, size: int) -> DataFrame:
    """``seq_emb_k`` and ``seq_anomaly`` for each row; keys never seen get the mean embedding."""
    means = embedded.agg(F.array(*[F.avg(F.col("embedding")[k]) for k in range(size)]).alias("_mean"), F.avg("anomaly").alias("_anomaly"))
    looked = embedded.select(F.col(key).alias("_key"), "embedding", "anomaly")
    joined = df.join(looked, F.col(key) == F.col("_key"), "left").crossJoin(F.broadcast(means))
    return joined.select(*df.columns, *[F.coalesce(F.col("embedding")[k], F.col("_mean")[k]).cast("float").alias(f"seq_emb_{k}") for k in range(size)], F.coalesce("anomaly", "_anomaly").alias("seq_anomaly"))

