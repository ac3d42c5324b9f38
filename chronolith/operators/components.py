"""Connected components of an edge table, by alternating large and small stars.

Each round replaces the edges by edges to smaller neighbours (Kiveris et al.,
"Connected Components in MapReduce and Beyond", SoCC 2014); after O(log^2 n)
rounds every node points at the smallest node of its component.  Nothing but a
row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.storage import forget, new_path, written

#: Bounds the nodes with so many edges that they are broadcast.
HUBS = 1000
#: Edges of a node above which it is no key of a join in a merge tree.
HUB_ROWS = 200_000


def _beside_least(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least ``v`` of each ``u``.

    Nodes with more than ``most`` edges would be one task's whole key in a join:
    there are few of them, and their least neighbours meet the edges by broadcast.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    others = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return others.unionByName(edges.join(hubs, "u"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _beside_least(both, most).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    # every edge points from the larger node to the smaller one here; the least itself stays, the others go to it
    near = _beside_least(edges, most)
    return near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with an edge to another node.

    ``component`` is the smallest node reachable.  Edges are undirected; nulls
    and self loops are dropped; repeated edges count once; without edges the
    result is empty.  Nodes may be of any type with an order.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    now = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen, last, spark = None, None, edges.sparkSession
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        path = new_path(spark, "stars")
        # at most 2 * HUBS nodes have so many edges, counted from both ends
        most = max(1000, mark[0] // HUBS)
        _small_star(_large_star(now, most), most).write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        # the round before is read no more; the last one is the result's
        if last:
            forget(spark, last)
        last = path
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


# --- components over time --------------------------------------------------------


def _beside(rows: DataFrame, key: str, side: DataFrame, most: int) -> DataFrame:
    """``rows`` left joined with ``side``, of one row for each ``key``; keys of more than ``most`` rows meet it by broadcast."""
    hot = F.broadcast(rows.groupBy(key).count().where(F.col("count") > most).select(key))
    # by a sort, since what is broadcast goes through the driver
    rest = rows.join(hot, key, "left_anti").join(side.hint("merge"), key, "left")
    return rest.unionByName(rows.join(hot, key, "left_semi").join(F.broadcast(side.join(hot, key, "left_semi")), key, "left"))


def _ranked(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``(rank, node)`` and the edges ``(u, v, at)`` between ranks, ``u`` the greater.

    Nodes with many edges come first, in steps of powers of two, and others by hash:
    so few edges lead from a node to lesser ones, and chains of heads are short
    whatever order the edges come in.
    """
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    order = [F.col("few"), F.xxhash64("node"), F.col("node")]
    counted = ends.groupBy("node").agg((-F.floor(F.log2(F.count(F.lit(1))))).alias("few"))
    named = written(counted.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("rank"), "node"), "ranks")
    a, b = (named.select(F.col("node").alias(end), F.col("rank").alias(r)) for end, r in (("src", "a"), ("dst", "b")))
    met = _beside(_beside(edges, "src", a, most), "dst", b, most)
    return named, met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), "at")


def _first(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("u", "v").agg(F.min("at").alias("at"))


def _to_earlier_least(edges: DataFrame) -> DataFrame:
    # a node keeps its first edge; each later one goes to the least that the node had met by then
    before = F.min("v").over(Window.partitionBy("u").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    m = F.coalesce(before, F.col("u"))
    return _first(edges.select(F.greatest("v", m).alias("u"), F.least("v", m).alias("v"), "at"))


def _past_the_lesser(edges: DataFrame, most: int) -> DataFrame:
    # an edge to a node that met a lesser one before goes to the least of those
    met = edges.groupBy(F.col("u").alias("v")).agg(F.collect_list(F.struct(F.col("at").alias("t"), F.col("v").alias("n"))).alias("met"))
    least = F.array_min(F.transform(F.filter("met", lambda x: x["t"] < F.col("at")), lambda x: x["n"]))
    return _first(_beside(edges, "v", met, most).select("u", F.coalesce(least, F.col("v")).alias("v"), "at"))


def merge_tree(edges: DataFrame, most: int = HUB_ROWS, max_rounds: int = 200) -> tuple[DataFrame, DataFrame]:
    """``(rank, node)`` of all nodes of ``edges`` (src, dst, at), and ``(node, parent, at)`` between ranks.

    A component's head is its least rank.  A node is head of its component until
    ``at``, when the component meets that of the lesser ``parent``.  Places ``at``
    must differ.  The stars of :func:`connected_components` in the order of time:
    an edge only moves to a node that its end was connected with before, so what is
    connected at any time stays so (compare Smirnov and Morozov, "Triplet Merge
    Trees", 2017).  Moved edges lead to lesser nodes; when none moves, each node has
    one lesser neighbour, which is head at that time.
    """
    named, ranked = _ranked(edges, most)
    now, seen, last, spark = ranked, None, None, edges.sparkSession
    for _ in range(max_rounds):
        path = new_path(spark, "tree")
        _past_the_lesser(written(_to_earlier_least(now), "near"), most).write.parquet(path)
        now = spark.read.schema("u long, v long, at long").parquet(path)
        if last:
            forget(spark, last)
        last = path
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v", "at"))).first())
        if mark == seen:
            return named, now.select(F.col("u").alias("node"), F.col("v").alias("parent"), "at")
        seen = mark
    raise RuntimeError(f"the merge tree did not settle in {max_rounds} rounds")


def ancestors(tree: DataFrame, most: int = HUB_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of each node of a merge tree that has a parent, ``(node, chain)``, its later heads with the places from which they hold, and ``(node, weight)``, the nodes it stood for at its end."""
    now = written(tree.select("node", F.array(F.struct("at", F.col("parent").alias("node"))).alias("chain")), "chains")
    seen = None
    while (mark := now.agg(F.sum(F.size("chain"))).first()[0]) != seen:
        seen = mark
        more = now.select(F.col("node").alias("end"), F.col("chain").alias("more"))
        met = _beside(now.withColumn("end", F.element_at("chain", -1)["node"]), "end", more, most)
        now = written(met.select("node", F.concat("chain", F.coalesce("more", F.slice("chain", 1, 0))).alias("chain")), "chains")
    below = now.select(F.explode("chain.node").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return now, now.select("node").join(below.hint("merge"), "node", "left").select("node", (F.coalesce("n", F.lit(0)) + 1).alias("weight"))
