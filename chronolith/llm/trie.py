"""The trie of conversations that share prefixes.

A conversation is a sequence of turns (role, text); a node is a distinct sequence
of first turns.  Texts are hashed where they lie; after that a turn is its digest and
its length.  A prefix is named by its depth and the XOR of two 64-bit hashes of its
turns and their places, which adds up in parallel along a long conversation.

The smallest conversation with a prefix owns its node.  Who owns a prefix of some
depth owns all its deeper ones, so a conversation's first owned depth is found by
binary search: each round joins every conversation at the middle of its range with the
minima of all prefixes.  From there down a conversation owns a chain of nodes, which
hangs from the node above it, another's.  Chains are added up bottom-up: in round k
each takes what those 2**k chains below it hold, so deep nestings need few rounds.

Null roles and texts are empty; a null turn number comes first; turns with the same
number are ordered by digest, and repeated rows are turns of their own.  Rows without
a conversation id belong to no conversation.  Other columns do not count.  Without
conversations there are no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import look_up, number_in_groups, scanned
from chronolith.storage import written

#: Members whose ids one row joins before they are hashed.
PIECE = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, mark, chars)``: turns in order from 0, with digest and length in place of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", mark.alias("mark"), F.char_length(text).cast("long").alias("chars"))
    return number_in_groups(rows, ["conv_id"], ["turn", "mark"], "turns").select("conv_id", "pos", "mark", "chars")


def _prefixes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(conv_id, depth, d1, d2, chars, n)`` of every prefix, the empty one too; rows have (conv_id, depth from 1, mark, chars)."""
    hashed = rows.select("conv_id", "depth", "chars", *[F.xxhash64(F.lit(k), "depth", "mark").alias(f"x{k}") for k in (1, 2)])
    run = scanned(hashed, "conv_id", "depth", {"d1": "x1", "d2": "x2"}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"), zero.alias("chars"))
    return roots.unionByName(run.select("conv_id", F.col("depth").cast("long").alias("depth"), "d1", "d2", "chars"))


def first_owned(sizes: DataFrame, nodes: DataFrame, at_once: int = 4) -> DataFrame:
    """``(conv_id, n, first)``: the least depth that each conversation owns, n + 1 where it owns none.

    ``sizes`` is (conv_id, n); ``nodes`` has the minima as (owner, depth).  A
    conversation has one prefix of each depth, so the pair of them names it and no
    key of the join is hot.
    """
    most = sizes.agg(F.max("n")).first()[0]
    now = sizes.select("conv_id", "n", F.lit(0).cast("long").alias("low"), (F.col("n") + 1).alias("first"))
    minima = nodes.select(F.col("owner").alias("conv_id"), F.col("depth").alias("middle"), F.lit(True).alias("owned"))
    for k in range(((most or 0) + 1).bit_length()):
        asked = now.withColumn("middle", F.when(F.col("low") < F.col("first"), F.floor((F.col("low") + F.col("first")) / 2).cast("long")))
        told = asked.join(minima, ["conv_id", "middle"], "left")
        yes, open_ = F.coalesce("owned", F.lit(False)), F.col("middle").isNotNull()
        now = told.select("conv_id", "n", F.when(open_ & ~yes, F.col("middle") + 1).otherwise(F.col("low")).alias("low"), F.when(open_ & yes, F.col("middle")).otherwise(F.col("first")).alias("first"))
        if k % at_once == at_once - 1:
            now = written(now, "search")
    return now.select("conv_id", "n", "first")


def chain_totals(chains: DataFrame, names: list[str]) -> DataFrame:
    """``(chain, names...)`` summed over each chain and all that hang below it; ``chains`` is (chain, above, names...)."""
    now = written(chains.withColumnRenamed("above", "jump"), "chains")
    while not now.where("jump is not null").isEmpty():
        # after round k the sums hold what is less than 2**k chains below, and jump is the chain 2**k above
        more = now.where("jump is not null").groupBy(F.col("jump").alias("chain")).agg(*[F.sum(n).alias(f"more_{n}") for n in names])
        moved = look_up(now.where("jump is not null"), now.select(F.col("chain").alias("jump"), F.col("jump").alias("next")), ["jump"])
        next_ = moved.select("chain", "next")
        now = written(now.join(more, "chain", "left").join(next_, "chain", "left").select("chain", F.col("next").alias("jump"), *[(F.col(n) + F.coalesce(f"more_{n}", F.lit(0))).alias(n) for n in names]), "chains")
    return now.select("chain", *names)


def id_digests(members: DataFrame) -> DataFrame:
    """``(owner, depth, digest)``: SHA-256 of each node's conv_ids, ascending and comma-joined; ``members`` is (owner, depth, conv_id).

    Ids are joined in pieces in parallel; the pieces of a node are hashed one after the
    other as they stream by, since a SHA-256 cannot be taken in parts.
    """
    numbered = number_in_groups(members, ["owner", "depth"], ["conv_id"], "ends")
    piece = F.floor(F.col("pos") / PIECE).alias("piece")
    pieces = numbered.groupBy("owner", "depth", piece).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    dealt = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for owner, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("owner", "depth", "ids")], strict=True):
                if (owner, depth) != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (owner, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(done)
        if node:
            yield _digests([(*node, state.hexdigest())])

    return dealt.mapInArrow(run, "owner long, depth long, digest string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["owner", "depth", "digest"])


def tree(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie over ``rows`` (conv_id, depth from 1, mark, chars) and ``sizes`` (conv_id, n), which lists every conversation.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null for the
    root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (over
    the subtree), ``ends_sha256``.
    """
    sizes = written(sizes, "conversations")
    prefixes = written(_prefixes(written(rows, "rebuilt"), sizes), "prefixes")
    minima = prefixes.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = written(minima, "nodes")
    chains = written(first_owned(sizes, nodes), "owned")

    # the node above each chain, or the one that a conversation without a chain ends at
    hung = chains.where("first > 0").select("conv_id", "n", "first", (F.col("first") - 1).alias("depth"))
    placed = written(hung.join(prefixes.select("conv_id", "depth", "d1", "d2"), ["conv_id", "depth"]), "hung")
    found = look_up(placed, nodes.select("depth", "d1", "d2", F.col("owner").alias("above")), ["depth", "d1", "d2"])
    above = written(found.select("conv_id", "n", "first", "depth", "above"), "above")

    heads = above.where("first <= n").select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), F.col("above").alias("hangs"))
    linked = nodes.join(heads, ["owner", "depth"], "left").select("owner", "depth", "n_convs", "chars", F.when(F.col("depth") > 0, F.coalesce("hangs", "owner")).alias("parent"))
    linked = written(linked, "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    own = linked.join(children, ["owner", "depth"], "left").select("owner", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    own = written(own.withColumn("leaves", (F.col("n_children") == 0).cast("long")), "own")

    sums = ["saved", "leaves"]
    per_chain = own.groupBy(F.col("owner").alias("chain")).agg(*[F.sum(n).alias(n) for n in sums])
    parents = above.where("first <= n").select(F.col("conv_id").alias("chain"), "above")
    totals = chain_totals(per_chain.join(parents, "chain", "left").select("chain", "above", *sums), sums)
    hanging = above.where("first <= n").join(totals, above["conv_id"] == totals["chain"]).groupBy(F.col("above").alias("owner"), "depth").agg(*[F.sum(n).alias(f"hung_{n}") for n in sums])
    held = own.join(hanging, ["owner", "depth"], "left").select("owner", "depth", "parent", "n_convs", "n_children", *[(F.col(n) + F.coalesce(f"hung_{n}", F.lit(0))).alias(n) for n in sums])
    summed = scanned(written(held, "held"), "owner", "depth", {"saved_tokens": "saved", "n_leaves": "leaves"}, F.sum, lambda a, b: a + b, descending=True)

    ended = above.where("first > n").select(F.col("above").alias("owner"), "depth", "conv_id").unionByName(chains.where("first <= n").select(F.col("conv_id").alias("owner"), F.col("n").alias("depth"), "conv_id"))
    whole = summed.join(id_digests(ended), ["owner", "depth"], "left")
    return whole.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """:func:`tree` of a table (conv_id, turn, role, text) as it is."""
    rows = written(turns(conversations), "ordered-turns")
    return tree(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "mark", "chars"), rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
