"""The registered queries of the numbered operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import ans, chunks, decontam, feistel, merkle, packing, pst, simhash, tokens, toxicity, trie, urls, vectors
from chronolith.llm.common import held_out, look_up, read
from chronolith.storage import new_path, written

#: The rules of the URL contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
END_ID, TOKEN_LIMIT = 2, 1024
#: A key for the registered query alone; a production run gives its own secret.
PSEUDONYM_KEY = "registered query"


def op1_ans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "ans")
    ans.encode(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    ids = F.col("ids")
    return ans.decode(spark, path).select("doc_id", "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))


def op3_redirect_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urls.RULES_SCHEMA)
    return urls.judge(read(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_groups(read(spark, sf_dir, "documents"))


def op4_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 0))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feistel.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), F.transform("pii", lambda p: p["kind"]).alias("kinds"))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(read(spark, sf_dir, "documents"))


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = pst.score(docs, ~held_out("doc_id", 1))
    return scored.select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_matches(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256)
    return found.select("doc_id", "n_words", F.col("hit_words").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("hit_words") > 0).alias("contaminated"))


def op10_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = ans.token_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return packing.pack(lengths, F.col("n_tokens"))


def _rebuilt(own: DataFrame, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, mark, chars) and sizes (conv_id, n) of conversations whose first turns come from another, by the contract."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    model = F.col("conv_id") - F.col("conv_id") % 100
    first = F.array_sort(F.collect_list(F.struct("pos", "mark", "chars"))).alias("first")
    models = own.where(F.col("conv_id") % 100 == 0).where(F.col("pos") < most - 1).groupBy("conv_id").agg(first).withColumnRenamed("conv_id", "model")
    each = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("model", model).join(models, "model", "left")
    each = each.select("conv_id", "own", taken.alias("h"), F.coalesce(F.slice("first", F.lit(1), taken.cast("int")), F.array().cast("array<struct<pos:long,mark:binary,chars:long>>")).alias("first"))
    each = written(each.withColumn("k", F.size("first").cast("long")), "models")
    begun = each.select("conv_id", F.explode("first").alias("f")).select("conv_id", (F.col("f.pos") + 1).alias("depth"), "f.mark", "f.chars")
    kept = written(own.where(F.col("pos") >= taken), "own-turns")
    went_on = look_up(kept, each.select("conv_id", "h", "k"), ["conv_id"]).select("conv_id", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "mark", "chars")
    return begun.unionByName(went_on), each.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.tree(*_rebuilt(written(trie.turns(read(spark, sf_dir, "conversations")), "ordered-turns")))


def op11_sign_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    # what tampering leaves as it is needs no second leaf
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("order_id"), merkle.leaf(*fields, F.col("text")).alias("leaf"), F.when(struck, merkle.leaf(*fields, cut)).alias("tampered"))
    rows = merkle.manifest(leaves, "tampered")
    folded = rows.select(F.col("order_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return folded.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ans_tokens, op2_chunk_recipes, op3_redirect_urls, op4_subword_toxicity, op5_feistel_pseudonyms, op6_golay_simhash, op7_token_counts, op8_suffix_tree_scores, op9_suffix_decontamination, op10_length_buckets, op11_sign_hash_vectors, op12_prefix_trie, op13_merkle_manifest)}
