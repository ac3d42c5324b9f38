"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own characters say so, in any script,
so equal stretches give equal chunks wherever they stand.  A chunk's identifier is its
64-bit hash, verified over the whole corpus against the chunk's SHA-256: where
two chunks share a hash, their documents are told apart by the digests.  A
document becomes the ordered list of its chunks' identifiers, and documents are
equal when the lists are; the texts are read where they lie and never shuffled.

Null texts count as empty, and empty texts equal each other.  Of equal texts the
longest original stays, then the smallest id; null ids come last.  Rows that
repeat an id and a text get the same result each, and :func:`deduplicate` keeps
one of them.  An empty table gives no rows; other columns pass through
:func:`deduplicate` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import SPACE, by_ids
from chronolith.storage import written


#: Stretches of code points (from, to, how many in a row) of which every fifth such row is in the boundary class.
CLASS_ROWS = ((0x21, 0x590, 1), (0x590, 0x3200, 8), (0x3200, 0x10000, 64), (0x10000, 0x1F000, 1024), (0x1F000, 0x20000, 64), (0x20000, 0x110000, 4096))


def boundary_class(modulus: int = 5, rest: int = 2) -> str:
    """A pattern class with about one in ``modulus`` characters of every script.

    Single characters where alphabets are small, rows of neighbours elsewhere, so
    that the class stays short.  Latin-1 comes first, so its characters need no
    look at the rest.
    """
    latin, others = [], []
    for low, high, row in CLASS_ROWS:
        for k, at in enumerate(range(low, high, row)):
            if (k + low) % modulus == rest:
                (latin if at < 0x100 else others).append(f"\\x{{{at:x}}}" + (f"-\\x{{{at + row - 1:x}}}" if row > 1 else ""))
    return "[" + "".join(latin) + "[[^\\x00-\\xff]&&[" + "".join(others) + "]]]"


def chunk_pattern(least: int = 128, most: int = 4096, marks: int = 3) -> str:
    """A chunk ends after ``marks`` characters of the class, ``least`` characters on, or at ``most``."""
    return f"(?s).{{{least},{most}}}?{boundary_class()}{{{marks}}}|.{{1,{most}}}"


def recipes(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, text_sha256, ids, exact)``: each row's ordered chunk identifiers.

    ``exact`` is null unless a chunk's hash is shared with another chunk; then it
    lists place and digest of those chunks.
    """
    text = F.coalesce("text", F.lit(""))
    bare = docs.select("doc_id", F.char_length(text).alias("n"), F.regexp_replace(text, SPACE + "+", "").alias("bare"))
    cut = bare.select("doc_id", "n", F.sha2("bare", 256).alias("text_sha256"), F.regexp_extract_all("bare", F.lit(chunk_pattern()), F.lit(0)).alias("chunks"))
    # written once: texts are cut and hashed one time, and are not needed again
    marked = written(cut.select("doc_id", "n", "text_sha256", F.transform("chunks", lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))).alias("marks")), "chunk-marks")
    each = marked.select(F.explode("marks").alias("m")).select("m.h", "m.d").distinct()
    shared = written(each.groupBy("h").count().where("count > 1").select("h"), "shared-hashes")
    rows = marked.select("doc_id", "n", "text_sha256", F.col("marks.h").alias("ids"))
    if shared.isEmpty():
        return rows.withColumn("exact", F.lit(None).cast("array<struct<pos:int,d:binary>>"))
    touched = marked.select("doc_id", "text_sha256", F.posexplode("marks").alias("pos", "m")).select("doc_id", "text_sha256", "pos", F.col("m.h").alias("h"), F.col("m.d").alias("d")).distinct()
    exact = touched.join(shared, "h").groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("pos", "d"))).alias("exact"))
    same = rows["doc_id"].eqNullSafe(exact["doc_id"]) & (rows["text_sha256"] == exact["text_sha256"])
    return rows.join(exact, same, "left").select(rows["*"], "exact")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs`` (doc_id, text)."""
    rows = written(recipes(docs.select("doc_id", "text")), "recipes")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    groups = rows.groupBy("ids", "exact").agg(F.count(F.lit(1)).alias("group_size"), best)
    same = (rows["ids"] == groups["ids"]) & rows["exact"].eqNullSafe(groups["exact"])
    found = rows.join(groups, same)
    keep = F.col("best.doc_id")
    kept = rows["doc_id"].eqNullSafe(keep) & (F.col("best.m") == -F.col("n"))
    return found.select(rows["doc_id"], keep.alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    judged = written(exact_groups(docs), "exact-groups")
    gone = judged.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha"), F.lit(True).alias("gone")).distinct()
    stay = judged.where("kept").select(F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha")).distinct()
    text_sha = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE + "+", ""), 256)
    # an id can both stay and go only where rows repeat it, and a null id equals none; those few rows are reduced by themselves
    mixed = judged.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("mixed_id"))
    if mixed.isEmpty():
        return by_ids(docs, gone.select(F.col("gone_id").alias("doc_id")), "left_anti")
    single = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["mixed_id"]), "left_anti")
    single = by_ids(single, gone.select(F.col("gone_id").alias("doc_id")), "left_anti")
    many = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["mixed_id"]), "left_semi").withColumn("chronolith_sha", text_sha).withColumn("chronolith_n", F.char_length(F.coalesce("text", F.lit(""))))
    many = many.join(stay, many["doc_id"].eqNullSafe(stay["stay_id"]) & (many["chronolith_sha"] == stay["stay_sha"]), "left_semi")
    longest = many.groupBy("doc_id", "chronolith_sha").agg(F.max("chronolith_n").alias("most")).select(F.col("doc_id").alias("most_id"), F.col("chronolith_sha").alias("most_sha"), "most")
    many = many.join(longest, many["doc_id"].eqNullSafe(longest["most_id"]) & (many["chronolith_sha"] == longest["most_sha"]) & (many["chronolith_n"] == longest["most"]), "left_semi")
    return single.unionByName(many.dropDuplicates(["doc_id", "chronolith_sha"]).drop("chronolith_sha", "chronolith_n"))
