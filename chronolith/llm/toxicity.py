"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of its own vector and of those of its character 3- to
5-grams, all hashed to buckets; a text is the mean of its words; a linear
softmax reads the class.  Vectors and softmax are trained jointly in numpy, on
a bounded sample of labelled rows: at most ``per_class`` of each class, drawn by
a hash of the id.  Misspelt words never seen share n-grams with
words that were.

Because all is linear, a trained word contributes one number, kept per worker,
and a text's score is a mean over its words.  Null, empty and wordless texts get
the score of the bias alone; whole texts are read; rows that repeat are scored
each; labels other than 0 and 1 are not used, and of two labels of one id the
greater counts; without labels of both classes every score is the share of toxic
labels, or 0 without any.  A model that has seen both classes but nothing that
tells them apart never says toxic: its bias stays under even odds.

Which buckets have vectors follows the sample: all whose share of texts differs
between the classes beyond chance, by the false discovery rate over all buckets
seen, and in any case those of the ``always`` first that differ about as much as the
very first does, so that a handful of labels can teach a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from chronolith.llm.common import map_batches, texts_of
from chronolith.storage import written

#: ASCII that is not a letter or digit parts words; other characters belong to them.
_KEEP = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(128)) + bytes(range(128, 256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


def buckets_of(word: bytes, n_buckets: int) -> list[int]:
    """The buckets of a word and of its character 3- to 5-grams."""
    marked = "<" + word.decode("utf-8", "replace") + ">"
    grams = {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [crc32(g.encode()) % n_buckets for g in sorted(grams | {marked})]


@dataclass
class Model:
    """What scoring needs: each bucket's push to the toxic class, and the bias."""

    push: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.push[buckets_of(word, len(self.push))].mean())


def features(text: str, n_buckets: int, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, shares)``: how much each bucket's vector counts in the text's mean of word means."""
    bag = Counter(words_of(text))
    if not bag:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(known) > 200_000:
        known.clear()
    grams = [known[w] if w in known else known.setdefault(w, np.array(buckets_of(w, n_buckets), np.int32)) for w in bag]
    weights = [np.full(len(g), n / bag.total() / len(g)) for g, n in zip(grams, bag.values(), strict=True)]
    own, place = np.unique(np.concatenate(grams), return_inverse=True)
    return own.astype(np.int64), np.bincount(place, np.concatenate(weights))


def train(text: np.ndarray, bucket: np.ndarray, share: np.ndarray, y: np.ndarray, prior: float, n_buckets: int, dim: int = 2, rounds: int = 200, rate: float = 1.0, ridge: float = 1e-7, seed: int = 7) -> Model:
    """Fit vectors and softmax jointly by Adam, then shift the bias to the share ``prior``.

    ``share[k]`` is the weight of ``bucket[k]`` in text ``text[k]``; both classes
    weigh the same in training.
    """
    odds = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if not ones or not zeros:
        return Model(np.zeros(n_buckets, np.float32), odds)
    used, place = np.unique(bucket, return_inverse=True)
    if not len(used):
        return Model(np.zeros(n_buckets, np.float32), min(odds, -0.1))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / zeros)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-0.1, 0.1, (len(used), dim))
    softmax, bias = random.normal(0, 0.3, (dim, 2)), np.zeros(2)
    moments = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in (("vectors", vectors), ("softmax", softmax), ("bias", bias))}

    def step(name: str, value: np.ndarray, gradient: np.ndarray, k: int, size: float) -> None:
        m, v = moments[name]
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient * gradient - v)
        value -= size * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-12)

    for k in range(1, rounds + 1):
        means = np.stack([np.bincount(text, vectors[place, d] * share, len(y)) for d in range(dim)], 1)
        logits = means @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None]
        down = p @ softmax.T
        pull = np.stack([np.bincount(place, down[text, d] * share, len(used)) for d in range(dim)], 1)
        size = rate * (1 - (k - 1) / rounds)
        step("softmax", softmax, means.T @ p + ridge * softmax, k, size)
        step("bias", bias, p.sum(0), k, 0.3 * size)
        step("vectors", vectors, pull + ridge * vectors, k, size)
    push = np.zeros(n_buckets, np.float32)
    push[used] = vectors @ (softmax[:, 1] - softmax[:, 0])
    # a text that nothing tells about is not toxic
    return Model(push, min(float(bias[1] - bias[0]) + odds, -0.1))


def telling(buckets: np.ndarray, zeros: np.ndarray, ones: np.ndarray, sizes: dict[int, int], rate: float, always: int) -> np.ndarray:
    """The buckets whose share of texts differs between the classes beyond chance.

    Of ``len(buckets)`` two-sided tests, as many as keep the share of false finds at
    ``rate`` (Benjamini and Hochberg, 1995), and the best of the ``always`` that differ most.
    """
    in_zero, in_one = zeros / sizes[0], ones / sizes[1]
    both = (zeros + ones) / (sizes[0] + sizes[1])
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / sizes[0] + 1 / sizes[1]))
    z = np.abs(in_zero - in_one) / error
    order = np.lexsort((buckets, -(zeros + ones), -z))
    chance = np.array([erfc(v / sqrt(2)) for v in z[order]])
    passed = np.flatnonzero(chance <= rate * np.arange(1, len(order) + 1) / max(1, len(order)))
    # of the best, those that differ about as much as the very best does, and by two errors at least
    best = order[:always]
    best = best[z[best] >= max(2.0, 0.9 * z[best].max(initial=0.0))]
    return buckets[np.union1d(order[: passed[-1] + 1 if len(passed) else 0], best).astype(np.int64)]


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None, per_class: int = 2000, n_buckets: int = 1 << 18, rate: float = 1e-4, always: int = 64, seed: int = 7) -> Model:
    """Train on at most ``per_class`` labelled rows of each class (labels: doc_id, toxic).

    The sample's n-grams are counted on the executors, and a count for each bucket
    reaches the driver.  Buckets that do not tell the classes apart (:func:`telling`)
    keep a zero vector: chance words would be learnt by heart.  Only the rest of
    the sample's weights reach the driver.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(trainable if trainable is not None else F.lit(True)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    drawn = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).select(F.col("doc_id").alias("chronolith_id"), "toxic")
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chronolith_id")).select("doc_id", "toxic", "text").repartition(8, "doc_id"), "labelled")
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(n_buckets, np.float32), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        seen, cache = np.zeros((2, n_buckets), np.int64), {}
        for label, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
            seen[label, features(text, n_buckets, cache)[0]] += 1
        some = np.flatnonzero(seen.any(0))
        yield {"bucket": some, "zeros": seen[0, some], "ones": seen[1, some]}

    counted = map_batches(sample, count, "bucket int, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    found = telling(*(counted[c].to_numpy(np.int64) for c in ("bucket", "zeros", "ones")), sizes, rate, always)
    mask = np.zeros(n_buckets, bool)
    mask[found] = True
    sent = spark.sparkContext.broadcast(mask)

    def weigh(batch: pa.RecordBatch) -> Iterator[dict]:
        cache: dict[bytes, np.ndarray] = {}
        found = []
        for text in texts_of(batch):
            own, weight = features(text, n_buckets, cache)
            some = sent.value[own]
            found.append((own[some].tolist(), weight[some].tolist()))
        yield {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "buckets": [f[0] for f in found], "shares": [f[1] for f in found]}

    rows = map_batches(sample, weigh, "doc_id long, toxic int, buckets array<int>, shares array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["buckets"]))
    text = np.repeat(np.arange(len(rows)), [len(r["buckets"]) for r in rows])
    bucket = np.array([b for r in rows for b in r["buckets"]], np.int64)
    share = np.array([w for r in rows for w in r["shares"]], np.float64)
    return train(text, bucket, share, np.array([r["toxic"] for r in rows], np.int64), prior, n_buckets, seed=seed)


class _Scorer:
    """A worker's words with their push."""

    def __init__(self, model: Model, limit: int = 250_000):
        self.model, self.limit, self.known = model, limit, {}

    def score(self, text: str) -> float:
        words = words_of(text)
        total = 0.0
        if words:
            known = self.known
            if len(known) > self.limit:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.model.word(w)
            total = sum(map(known.__getitem__, words)) / len(words)
        return 1 / (1 + float(np.exp(-min(60.0, max(-60.0, total + self.model.bias)))))


def scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability that ``text`` is toxic in a new column; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != column]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        scorer = _scorer(sent)
        yield {c: batch.column(c) for c in others} | {column: [scorer.score(t) for t in texts_of(batch)]}

    kept = docs.select(*[F.col(f"`{c}`") for c in others])
    return map_batches(kept, run, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


_scorers: dict[int, _Scorer] = {}


def _scorer(sent) -> _Scorer:
    """The worker's scorer for this broadcast model; an older model's is dropped."""
    key = id(sent.value)
    if key not in _scorers or _scorers[key].model is not sent.value:
        _scorers.clear()
        _scorers[key] = _Scorer(sent.value)
    return _scorers[key]


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with their columns."""
    names = ["text" if c == "text" else f"chronolith_{k}" for k, c in enumerate(docs.columns)]
    scored = scores(docs.toDF(*names), model, "chronolith_score")
    return scored.where(F.col("chronolith_score") < threshold).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)])
