"""SimHash near-duplicates, joined by fuzzy keys from the binary Golay code.

The [23, 12, 7] Golay code is perfect: every 23-bit word lies within 3 bits of
exactly one codeword.  Take as keys of a word the codewords nearest to it and to
its neighbours at one bit: two words at most 2 bits apart share a neighbour, so
they share a key, and a word has 6 keys at most.

A 64-bit fingerprint has three segments (22, 21, 21 bits).  Of two fingerprints
that differ in 2 bits or fewer, one segment is equal (pigeonhole) and the next
one has 2 errors or fewer, so the pair meets in a bucket named by the equal
segment and a Golay key of the next; a join and a bit count verify it.  Buckets
of many different fingerprints are not paired out: their members are linked
through the 65 words within one bit of each, which joins exactly what differs in
2 bits or fewer.  Links become classes by distributed connected components.

Documents with 0.8 or more of their 5-word shingles in common have fingerprints up
to 16 bits apart, out of reach of any Golay key.  :func:`similar_classes` therefore
takes MinHash bands as candidates beside the fuzzy links, and verifies all of them
with whole shingle sets.

Null texts are empty; texts without words have the fingerprint zero and are
linked like any other; equal fingerprints are one node, so copies cost nothing;
rows that repeat get the same class; null ids link like others but never name a
class, and a class of null ids alone has the name null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import by_ids, look_up, map_batches, texts_of
from chronolith.operators.components import connected_components
from chronolith.storage import written

#: Fixed value: a generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more different fingerprints than this is linked through neighbours instead of pairs.
PAIRED = 32
SEED = 42
#: Members of a large bucket, besides its ends, that all others are compared with.
CENTRES = 3
#: Sets that share a frequent shingle are compared in one task by twice as many at most.
BLOCK = 256


@lru_cache(maxsize=1)
def nearest_codeword() -> np.ndarray:
    """For each 23-bit word, the number (0 to 4095) of the codeword within 3 bits."""
    message = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(message >> bit & 1, np.uint32(GENERATOR << bit), np.uint32(0)).astype(np.uint32)
    one = np.uint32(1) << np.arange(23, dtype=np.uint32)
    pairs = np.array([one[i] | one[j] for i in range(23) for j in range(i)], np.uint32)
    triples = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)], np.uint32)
    out = np.full(1 << 23, 0xFFFF, np.uint16)
    for errors in np.concatenate([np.zeros(1, np.uint32), one, pairs, triples]):
        out[words ^ errors] = message
    return out


def golay_keys(values: np.ndarray, bits: int) -> np.ndarray:
    """Per value (of ``bits`` bits) a row of its keys; repeats are -1."""
    near = nearest_codeword()
    tries = np.concatenate([values[:, None], values[:, None] ^ (np.uint64(1) << np.arange(bits, dtype=np.uint64))], axis=1)
    keys = np.sort(near[tries.astype(np.int64)].astype(np.int64), axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return keys


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every bucket that each 64-bit fingerprint belongs to."""
    parts = [(prints >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    rows, keys = [], []
    for family in range(3):
        equal, fuzzy = parts[family], parts[(family + 1) % 3]
        codes = golay_keys(fuzzy, SEGMENTS[(family + 1) % 3][1])
        row, column = np.nonzero(codes >= 0)
        rows.append(row)
        keys.append((np.int64(family) << 36) | (equal[row].astype(np.int64) << 12) | codes[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    """XXH64 of each run of ``width`` words joined by a blank, or of the whole shorter sequence."""
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that over half of the hashes have."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def words_of(text: str) -> list[bytes]:
    """Words between white space, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, print)``: the SimHash of each row's word shingles, as a signed long; no shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        prints = [fingerprint(np.array(shingle_hashes(words_of(t), width), np.uint64)) for t in texts_of(batch)]
        yield {"doc_id": batch.column("doc_id"), "print": np.array(prints, np.uint64).view(np.int64)}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, print long")


def close_pairs(nodes: DataFrame) -> DataFrame:
    """``(src, dst)`` links between nodes (rep, print) whose distinct prints differ in 2 bits or fewer.

    All pairs of small buckets; for the members of large ones, links that join
    the same nodes.
    """

    def keys(batch: pa.RecordBatch) -> Iterator[dict]:
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        reps = batch.column("rep").to_numpy(zero_copy_only=False)
        row, key = bucket_keys(prints.astype(np.int64).view(np.uint64))
        yield {"key": key, "rep": reps[row], "print": prints[row]}

    keyed = map_batches(nodes.select("rep", "print"), keys, "key long, rep long, print long", slice_bytes=1 << 19)
    counts = keyed.groupBy("key").count().where("count > 1")
    met = written(keyed.join(counts, "key"), "buckets")
    small = met.where(F.col("count") <= PAIRED)
    left, right = small.select("key", F.col("rep").alias("src"), F.col("print").alias("p")), small.select("key", F.col("rep").alias("dst"), F.col("print").alias("q"))
    pairs = left.join(right, "key").where("p < q").where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= 2).select("src", "dst")
    large = met.where(F.col("count") > PAIRED).select("rep", "print").distinct()
    around = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k)) for k in range(64)])
    hubs = large.select("rep", F.explode(around).alias("hub"))
    centres = hubs.groupBy("hub").agg(F.min("rep").alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "dst")
    through = hubs.join(centres, "hub").where("rep <> dst").select(F.col("rep").alias("src"), "dst")
    return pairs.unionByName(through).distinct()


def near_classes(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row; prints link at 2 bits or fewer."""
    prints = written(fingerprints(docs, width), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "print-nodes")
    # a fingerprint is a node by itself, so rows without an id link like others; a class is named by its smallest id
    classes = connected_components(close_pairs(nodes.select(F.col("print").alias("rep"), "print")))
    placed = nodes.join(classes, nodes["print"] == classes["node"], "left").select("print", "least", F.coalesce("component", "print").alias("class"))
    placed = written(placed, "print-classes")
    names = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = look_up(placed, names, ["class"]).select("print", "component_id")
    return look_up(prints, named, ["print"]).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# --- near duplicates by similarity --------------------------------------------


def minhash_bands(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """Per band, one hash of the ``rows`` shingles that come first under its seeded orders: MinHash banding.

    A band stays as it is when the same shingles are drawn from both documents,
    which happens with the power ``rows`` of their Jaccard similarity.
    """
    out = []
    for band in range(bands):
        drawn = []
        for row in range(rows):
            seed = np.uint64((2 * (band * rows + row) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            mixed = (hashes ^ (hashes >> np.uint64(31))) * seed
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            drawn.append(int(hashes[int(np.argmin(mixed ^ (mixed >> np.uint64(32))))]))
        out.append(xxhash.xxh64_intdigest(np.array(drawn, "<u8").tobytes(), band))
    return out


def similar_pairs(docs: DataFrame, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Candidate ``(src, dst)`` ids: fuzzy SimHash links, and shared MinHash bands; and the large buckets (key, node).

    Members of large buckets are candidates of some of each other only; :func:`missed_links` finds their other links.
    """

    def keys(batch: pa.RecordBatch) -> Iterator[dict]:
        hashes = [np.array(shingle_hashes(words_of(t), width), np.uint64) for t in texts_of(batch)]
        prints = np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)
        yield {"doc_id": batch.column("doc_id"), "print": prints, "bands": [np.array(minhash_bands(h, bands, rows), np.uint64).view(np.int64).tolist() if len(h) else [] for h in hashes]}

    keyed = written(map_batches(docs.select("doc_id", "text"), keys, "doc_id long, print long, bands array<long>"), "sampled")
    nodes = keyed.groupBy("print").agg(F.min("doc_id").alias("rep"))
    same_print = keyed.join(nodes, "print").where("doc_id <> rep").select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))
    each = keyed.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("n > 1")
    met = written(each.join(counts, "key"), "met")
    small = met.where(F.col("n") <= PAIRED)
    left, right = small.select("key", F.col("node").alias("src")), small.select("key", F.col("node").alias("dst"))
    pairs = left.join(right, "key").where("src < dst").select("src", "dst")
    # in a large bucket, the members that meet most others over all their buckets are its centres, so that
    # an original meets each of its copies, however the copies differ from each other; so are both ends
    weights = met.groupBy("node").agg(F.sum("n").alias("w"))
    large = met.where(F.col("n") > PAIRED).select("key", "node")
    third = F.pmod(F.xxhash64("node"), F.lit(CENTRES)).alias("third")
    centres = large.join(weights, "node").groupBy("key", third).agg(F.max(F.struct("w", "node")).alias("c")).select("key", F.col("c.node").alias("src"))
    ends = met.where(F.col("n") > PAIRED).select(F.explode(F.array("least", "most")).alias("src"), F.col("node").alias("dst"))
    stars = large.join(centres, "key").select("src", F.col("node").alias("dst")).unionByName(ends)
    found = pairs.unionByName(stars).unionByName(same_print).unionByName(close_pairs(nodes))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct(), large


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``(src, dst)`` whose whole sets (doc_id, hashes) have a Jaccard similarity of ``similarity`` or more."""
    one, two = (sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(h)) for c, h in (("src", "a"), ("dst", "b")))
    both = F.size(F.array_intersect("a", "b"))
    sized = pairs.join(one, "src").join(two, "dst").where(F.least(F.size("a"), F.size("b")) >= F.greatest(F.size("a"), F.size("b")) * similarity)
    return sized.where((both > 0) & (both >= (F.size("a") + F.size("b") - both) * similarity)).select("src", "dst")


def block_links(block: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links ``(src, dst)`` that join the parts of all similar sets of a block (part, hashes)."""
    part, own = block["part"].to_numpy(), [np.asarray(h, np.int64) for h in block["hashes"]]
    n, sizes = len(own), np.array([len(h) for h in own], np.int64)
    names, column = np.unique(np.concatenate(own), return_inverse=True)
    owner, met = np.repeat(np.arange(n), sizes), np.bincount(column) > 1
    shared = met[column]
    owner, column = owner[shared], (np.cumsum(met) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.float64)
    step = 4096
    for start in range(0, int(met.sum()), step):
        low, high = np.searchsorted(column, (start, start + step))
        marks = np.zeros((n, step), np.float32)
        marks[owner[low:high], column[low:high] - start] = 1
        both += marks @ marks.T
    similar = (both > 0) & (both >= (sizes[:, None] + sizes[None, :] - both) * similarity) & (part[:, None] < part[None, :])
    src, dst = np.nonzero(similar)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in np.unique(np.stack([part[src], part[dst]], 1), axis=0).tolist():
        one, two = find(a), find(b)
        if one != two:
            root[one] = two
            out.append((a, b))
    return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")


def missed_links(large: DataFrame, sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links ``(src, dst)`` between the classes that meet in a large bucket, from all similar pairs of those buckets' members.

    An exact set-similarity join of the members of buckets that hold several
    classes: equal sets are one; two similar sets share one of the shingles that
    are first of ``1 - similarity`` of each, rare ones first.  Few sets with such a
    shingle are paired; many are dealt to blocks, and each two blocks compared
    in one task.  Pairs of one class need no comparison.
    """
    named = large.join(classes.select(F.col("doc_id").alias("node"), "component_id"), "node", "left").select("key", "node", F.coalesce("component_id", "node").alias("part"))
    mixed = named.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("key")
    members = written(named.join(mixed, "key", "left_semi").select(F.col("node").alias("doc_id"), "part").distinct(), "open-members")
    equal = sets.join(members, "doc_id").groupBy("hashes").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    one = written(equal.select(F.monotonically_increasing_id().alias("doc_id"), F.col("parts")[0].alias("part"), "parts", "hashes", F.size("hashes").alias("size")), "open-sets")
    same = one.select(F.col("part").alias("src"), F.explode("parts").alias("dst")).where("src <> dst")
    each = one.select("doc_id", F.explode("hashes").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    # shingles of no other set come first and meet nothing
    length = (F.floor(F.col("size") * (1 - similarity) + 1e-6) + 1 - F.col("size") + F.size("ranked")).cast("int")
    first = one.select("doc_id", "part", "size").join(ranked, "doc_id").withColumn("length", length).where("length > 0")
    prefixes = written(first.select("doc_id", "part", "size", F.explode(F.slice("ranked", F.lit(1), F.col("length"))["token"]).alias("token")), "prefixes")
    signs = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))).alias(f"sign{k}") for k in range(2)]
    groups = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("a"), F.max("part").alias("b"), *signs).where("a <> b")
    # shingles of the same sets ask for the same comparisons
    groups = written(groups.groupBy("n", "sign0", "sign1").agg(F.min("token").alias("token")).select("token", "n"), "prefix-groups")
    few = prefixes.join(groups.where(F.col("n") <= PAIRED), "token")
    left, right = (few.select("token", F.col("doc_id").alias(c), F.col("part").alias(p), F.col("size").alias(s)) for c, p, s in (("src", "p", "s"), ("dst", "q", "z")))
    near = (F.col("p") != F.col("q")) & (F.least("s", "z") >= F.greatest("s", "z") * (similarity - 1e-6))
    pairs = written(left.join(right, "token").where("src < dst").where(near).select("src", "dst").distinct(), "prefix-pairs")
    parts = one.select("doc_id", "part")
    ends = [parts.select(F.col("doc_id").alias(c), F.col("part").alias(p)) for c, p in (("src", "p"), ("dst", "q"))]
    few_links = verified(pairs, one, similarity).join(ends[0], "src").join(ends[1], "dst").select(F.col("p").alias("src"), F.col("q").alias("dst"))
    many = prefixes.join(groups.where(F.col("n") > PAIRED), "token").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = many.select("token", "doc_id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("token", "doc_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(one.select("doc_id", "part", "hashes"), "doc_id")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        return block_links(block, similarity)

    many_links = dealt.select("token", "i", "j", "part", "hashes").groupBy("token", "i", "j").applyInPandas(compare, "src long, dst long")
    return same.unionByName(few_links).unionByName(many_links)


def similar_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 10, rows: int = 3) -> DataFrame:
    """``(doc_id, component_id)`` of rows linked by a Jaccard similarity of ``similarity`` or more.

    Candidates are verified with the whole sets of ``width``-word shingles.  Rows
    with a null id are left out; texts without words are never similar; rows
    that share an id are one document and linked if any of them is.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    pairs, large = similar_pairs(known, width, bands, rows)
    pairs = written(pairs, "candidates")
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()

    def sets(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"doc_id": batch.column("doc_id"), "hashes": [np.unique(np.array(shingle_hashes(words_of(t), width), np.uint64)).view(np.int64).tolist() for t in texts_of(batch)]}

    own = written(map_batches(by_ids(known, wanted, "left_semi"), sets, "doc_id long, hashes array<long>"), "shingle-sets")
    found = connected_components(verified(pairs, own, similarity)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    merged = connected_components(missed_links(large, own, found, similarity))
    joined = found.join(merged, found["component_id"] == merged["node"], "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))
    alone = merged.join(found, merged["node"] == found["doc_id"], "left_anti").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    return joined.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each class of similar ones: the one with the smallest id."""
    gone = written(similar_classes(docs, width, similarity).where("doc_id <> component_id").select("doc_id"), "near-duplicates")
    return by_ids(docs, gone, "left_anti")
