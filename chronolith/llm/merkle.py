"""A Merkle manifest of a data set, in DataFrame functions only.

A row's leaf is the SHA-256 of its fields; the leaves of a group, in the order of
their ids, are hashed ``FAN`` at a time, level by level, to the group's subroot, and the
subroots in the order of the groups to the root.  Digests are lowercase hex text.

Leaves are numbered within their group in parallel and dealt to blocks of
``FAN ** LEVELS``, arrays of fixed size whose levels higher-order functions
collapse; the blocks' roots are the next leaves, until each group has one.  Paths
come down the same way: a node's siblings are those in its block and then those
of its block's root.  No task holds more than a block, however large a group is.

A null field is ``-``, so a null and an empty text differ.  A null group comes
first and is a group like any other; null ids come first in their group; rows
that tie on their id are ordered by leaf, so rows that repeat have leaves of
their own.  Other columns do not count.  A group of one row has that row's leaf as
subroot, and a table of one group that group's subroot as root.  An empty table
has no rows and no root.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import number_in_groups
from chronolith.storage import written

#: Nodes that are hashed together.
FAN = 3
#: Levels that a block collapses: 243 leaves.
LEVELS = 5
BLOCK = FAN**LEVELS


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def _levels(leaves: Column, first: Column) -> Column:
    """All levels of a block from its leaves up to one node; ``first``: the block may be its group's only one."""
    n = F.size(leaves)
    # a first block that is not full is the only one; all others go up the full number of levels
    needed = reduce(lambda a, b: a + b, [(n > FAN**k).cast("int") for k in range(LEVELS)])
    height = F.when(first & (n < BLOCK), needed).otherwise(LEVELS)

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FAN + 1, FAN), "")))

    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), height)
    return F.aggregate(steps, F.array(leaves), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))


def _siblings(levels: Column, place: Column) -> Column:
    """For the leaf at ``place`` (from 0), the digests left and right of its node, level by level."""
    powers = F.array(*[F.lit(FAN**k) for k in range(LEVELS)])

    def at(level: Column, k: Column) -> Column:
        node = F.floor(place / F.element_at(powers, k + 1)).cast("int")
        inside = node % FAN
        return F.struct(F.array_join(F.slice(level, node - inside + 1, inside), "").alias("l"), F.array_join(F.slice(level, node + 2, F.lit(FAN - 1) - inside), "").alias("r"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _grow(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """Blocks (grp, block, members, levels) of ``nodes`` (grp, pos, node), of their roots, and so on to one root a group."""
    out: list[DataFrame] = []
    while True:
        block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
        members = F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("members")
        blocks = nodes.groupBy("grp", block).agg(members)
        out.append(written(blocks.withColumn("levels", _levels(F.col("members.node"), F.col("block") == 0)), "merkle-blocks"))
        carried = ()
        nodes = out[-1].select("grp", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        # one row to the driver
        if not nodes.agg(F.max("pos")).first()[0]:
            return out


def _paths(blocks: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """``(grp, path, pos, node, ...)`` of the leaves of :func:`_grow`.

    ``above`` has (grp, path) of the groups' roots and columns that each leaf of the group gets.
    """
    if above is None:
        up, more = None, []
    else:
        up, more = above.withColumn("block", F.lit(0).cast("long")), [c for c in above.columns if c not in ("grp", "path")]
    for level in reversed(blocks):
        held = level.withColumn("path", F.array().cast("array<struct<l:string,r:string>>")) if up is None else level.join(up, ["grp", "block"])
        each = F.transform("members", lambda m, i: F.struct(m.alias("m"), _siblings(F.col("levels"), i).alias("own")))
        rows = held.select("grp", "path", *more, F.explode(each).alias("e")).select("grp", F.concat("e.own", "path").alias("path"), *more, "e.m.*")
        up = rows.select("grp", "path", *more, F.col("pos").alias("block"))
    return rows


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def proof(path: Column) -> Column:
    """The digest of a path's siblings, from the leaf up and left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(leaves: DataFrame, *carried: str) -> DataFrame:
    """``(order_id, leaf, path, subroot, root, carried...)`` of every leaf.

    ``leaves`` has ``grp`` (string), ``order_id``, ``leaf`` and the columns to
    carry.  ``path`` lists, from the leaf to the root, the joined digests left
    (``l``) and right (``r``) of the node in its run.
    """
    # inside, a group's name is never null, and keeps its order by bytes with null first
    named = leaves.select(F.coalesce(F.concat(F.lit("="), "grp"), F.lit("")).alias("grp"), "order_id", F.col("leaf").alias("node"), *carried)
    blocks = _grow(number_in_groups(named, ["grp"], ["order_id", "node"], "merkle-leaves"), "order_id", *carried)
    subroots = blocks[-1].select(F.lit("").alias("all"), "grp", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    ranked = number_in_groups(subroots, ["all"], ["grp"], "merkle-groups")
    top = _grow(ranked.select(F.col("all").alias("grp"), "pos", "node", F.col("grp").alias("name")), "name")
    root = top[-1].select(F.element_at(F.element_at("levels", -1), 1).alias("root"))
    above = _paths(top, None).select(F.col("name").alias("grp"), "path", F.col("node").alias("subroot"))
    rows = _paths(blocks, written(above, "merkle-top")).crossJoin(F.broadcast(root))
    return rows.select("order_id", F.col("node").alias("leaf"), "path", "subroot", "root", *carried)
