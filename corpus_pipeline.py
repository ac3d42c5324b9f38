"""A corpus pipeline: from raw documents to packed training batches.

Each stage takes what the one before it kept and returns rows with the columns
of ``documents``, except the last, which returns the packing.

Null texts count as empty in every stage, and empty texts are equal to each other
and never near duplicates.  A null id is a document like any other: it may be
rejected as toxic, as an equal copy or for a benchmark passage, and is packed;
only near-dedup leaves it as it is.  Of rows that repeat, exact dedup keeps one;
of equal texts it keeps the longest original, then the smallest id; of similar
ones near-dedup keeps the smallest id.  Extra columns pass through every stage but
the last.  An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import ans, chunks, decontam, packing, simhash, toxicity
from chronolith.llm.common import read
from chronolith.storage import written

#: The end-of-document id that every packed document carries.
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose toxicity score is 0.5 or more."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents that are equal without white space."""
    return chunks.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each class of documents with 0.8 or more of their 5-word shingles in common."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold 10 consecutive words of a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the documents to length buckets and token-budget batches, by their number of token ids with the end id."""
    return packing.pack(ans.token_lengths(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID), F.col("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark_leaks), ("packing", pack)]

#: SQL cannot express the first stage's model; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
