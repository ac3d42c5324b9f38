"""Near-duplicate embeddings by random-hyperplane sign hashing, with exact cosines.

Vectors with equal labels and values are one node, so copies meet once however
many there are.  A node's side of random hyperplanes gives its key in each of several
tables; nodes with the same label and key share a bucket, and every pair in a
bucket is compared by its cosine in double precision.  Nothing is dropped: a
bucket of more than ``BLOCK`` nodes is cut into blocks by hash, and each two
blocks are a group of their own, for whatever task; a group yields one row for a node
with links, not one for a pair.  A pair counts in the first table in which it
meets, which the nodes' keys show, so links are counted once without a list of pairs.

The number of bits follows from the number of nodes (some ``BUCKET`` strangers to a
bucket) and the number of tables from the recall asked for: a pair right at the
threshold is found with that probability, closer ones with a higher one, at any size.

Vectors that are null, empty or zero, or hold null or non-finite components, and
those without a label, link with nothing and are classes of their own; so do vectors of
different length.  Rows that repeat are linked copies.  A null id counts as a vector,
but a class is named by its smallest id that is not null; where there is none
the name is null.  Other columns do not count.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import cut, look_up
from chronolith.operators.components import connected_components
from chronolith.storage import written

#: Nodes that a block of a large bucket has, about.
BLOCK = 512
#: Strangers that share a bucket, about, where directions are even.
BUCKET = 16
SEED = 20_011


@dataclass(frozen=True)
class Tables:
    """How many tables of how many bits."""

    bits: int
    tables: int


def plan(nodes: int, threshold: float, recall: float) -> Tables:
    """Bits that part strangers, and the tables that find a pair at ``threshold`` with probability ``recall``."""
    bits = min(62, max(8, ceil(log2(max(nodes, 1) / BUCKET))))
    agree = (1 - acos(threshold) / pi) ** bits
    return Tables(bits, ceil(log(1 - recall) / log(1 - agree)))


@lru_cache(maxsize=8)
def planes(dim: int, shape: Tables) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, shape.tables * shape.bits))


def keys_of(vectors: np.ndarray, shape: Tables) -> np.ndarray:
    """A key of each vector in each table; it depends on the direction alone."""
    sides = (vectors @ planes(vectors.shape[1], shape) > 0).reshape(len(vectors), shape.tables, shape.bits)
    return sides @ (np.int64(1) << np.arange(shape.bits, dtype=np.int64))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision by their largest component, so that squares neither overflow nor vanish."""
    vectors = vectors.astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    column = batch.column(name)
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values), offsets


def nodes_of(vectors: DataFrame) -> DataFrame:
    """``(node, label, vec, copies, least)``: the distinct vectors that can link, with their number of rows and smallest id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    classes = vectors.where(F.coalesce(usable, F.lit(False))).groupBy(F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec"))
    # numbered once they are written, so that numbers stay when a task runs again
    return written(written(classes.agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "distinct-vectors").select(F.monotonically_increasing_id().alias("node"), "label", "vec", "copies", "least"), "nodes")


def with_keys(nodes: DataFrame, shape: Tables) -> DataFrame:
    """``nodes`` with ``keys``, one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in cut(batch, 1 << 21):
                flat, at = _rows(piece, "vec")
                sizes, keys = np.diff(at), np.zeros((piece.num_rows, shape.tables), np.int64)
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    keys[rows] = keys_of(scaled(flat[at[rows][:, None] + np.arange(dim)]), shape)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, shape.tables, dtype=np.int32), keys.reshape(-1))
                yield pa.RecordBatch.from_arrays([*piece.columns, lists], [*piece.schema.names, "keys"])

    return nodes.mapInArrow(run, nodes.withColumn("keys", F.array().cast("array<long>")).schema)


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest position that each position of a symmetric link matrix reaches."""
    root = np.arange(len(linked))
    while True:
        near = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        near = near[near]
        if (near == root).all():
            return root
        root = near


def compare(node: np.ndarray, copies: np.ndarray, vectors: np.ndarray, keys: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(node, links, root)`` of the nodes of one group with links that no earlier table shows.

    Where the group is of two blocks (``side`` 0 and 1), only pairs across count.
    """
    unit = scaled(vectors)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    for earlier in range(table):
        if not linked.any():
            break
        linked &= keys[:, earlier][:, None] != keys[:, earlier][None, :]
    links = linked @ copies
    has = links > 0
    return node[has], links[has], node[local_roots(linked)[has]] if has.any() else node[has]


def links_in_buckets(members: DataFrame, threshold: float) -> DataFrame:
    """``(node, links, root)`` rows of all groups of ``members`` (bucket, a, b, side, table, node, copies, vec, keys)."""
    dealt = members.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            whole = pa.concat_batches([rest, batch]) if rest is not None and rest.num_rows else batch
            if whole.num_rows:
                changes = _changes(whole)
                # the last group may go on in the next batch
                last = changes[-1]
                yield _compared(whole.slice(0, last), changes, threshold)
                rest = whole.slice(last)
        if rest is not None and rest.num_rows:
            yield _compared(rest, np.array([0, rest.num_rows]), threshold)

    return dealt.mapInArrow(run, "node long, links long, root long")


def _changes(batch: pa.RecordBatch) -> np.ndarray:
    """Where groups begin."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in ("bucket", "a", "b"):
        column = batch.column(name)
        if column.type in (pa.string(), pa.large_string()):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _compared(batch: pa.RecordBatch, edges: np.ndarray, threshold: float) -> pa.RecordBatch:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if batch.num_rows:
        flat, at = _rows(batch, "vec")
        keys, key_at = _rows(batch, "keys")
        width = int(key_at[1] - key_at[0])
        node, copies, side, table = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "copies", "side", "table"))
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if stop - start > 1:
                rows = slice(start, stop)
                vectors = flat[at[start] : at[stop]].reshape(stop - start, -1)
                out.append(compare(node[rows], copies[rows], vectors, keys[key_at[start] : key_at[stop]].reshape(-1, width), side[rows], int(table[start]), threshold))
    columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "root"])


def grouped(rows: DataFrame, large: DataFrame | None, few: bool) -> DataFrame:
    """Members of buckets as members of groups (bucket, a, b): a large bucket's blocks meet in pairs, each with itself too."""
    if large is None:
        return rows.withColumns({"a": F.lit(0), "b": F.lit(0), "side": F.lit(0)})
    sized = rows.join(F.broadcast(large), "bucket", "left") if few else look_up(written(rows, "bucket-members"), large, ["bucket"])
    blocks = F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int")
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("count")
    second = (F.col("own") > F.col("other")).cast("int")
    return dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other"), "side": second}).drop("own", "other")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.9999, at_once: int = 2, few: int = 100_000) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors`` (vec_id, embedding, label).

    ``n_links`` counts the other rows with a cosine of ``threshold`` or more to
    the row's vector, ``component_id`` is the smallest id that links reach, and
    ``kept`` is true where that is the row's own.  ``at_once`` tables are compared
    at a time, so there are that many copies of the vectors on disk.  Up to ``few`` large
    buckets are broadcast, each a name and a count.
    """
    nodes = nodes_of(vectors)
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    shape = plan(most, threshold, recall)
    keyed = written(with_keys(nodes.drop("least"), shape), "keyed-vectors")
    bucket = F.concat_ws("|", "e.table", "e.key", F.size("vec"), "label").alias("bucket")

    def members(begin: int, end: int) -> DataFrame:
        tables = F.sequence(F.lit(begin), F.lit(end - 1))
        each = keyed.select("*", F.explode(F.transform(tables, lambda t: F.struct(t.alias("table"), F.get("keys", t).alias("key")))).alias("e"))
        return each.select("node", "copies", "vec", "keys", "e.table", bucket)

    large: DataFrame | None = written(members(0, shape.tables).groupBy("bucket").count().where(F.col("count") > BLOCK), "large-buckets")
    n_large = large.count()
    found = [written(links_in_buckets(grouped(members(k, min(k + at_once, shape.tables)), large if n_large else None, n_large <= few), threshold), "vector-links") for k in range(0, shape.tables, at_once)]
    linked = reduce(DataFrame.unionByName, found)
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(linked, "node", "root").withColumnRenamed("component", "class")
    placed = nodes.join(links, "node", "left").join(classes, "node", "left")
    placed = written(placed.select("label", "vec", "least", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "placed-vectors")
    names = placed.groupBy("class").agg(F.min("least").alias("component_id"))
    told = look_up(placed, names, ["class"]).select("label", "vec", "n_links", "component_id", F.lit(True).alias("linked"))
    rows = written(vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vec")), "vectors")
    # rows without label or vector have no node, and would be one key of the join
    whole = F.col("label").isNotNull() & F.col("vec").isNotNull()
    alone = rows.where(~whole).withColumns({"n_links": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long"), "linked": F.lit(None).cast("boolean")})
    met = look_up(rows.where(whole), told, ["label", "vec"]).unionByName(alone)
    named = met.withColumn("component_id", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id")))
    return named.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
