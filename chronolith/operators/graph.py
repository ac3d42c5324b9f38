"""Entity graph features that only look at earlier rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.components import HUB_ROWS, ancestors, merge_tree
from chronolith.operators.history import prior_aggregates
from chronolith.spec import Roles
from chronolith.storage import written
from chronolith.windows import prior


def entity_history(df: DataFrame, roles: Roles, entities: Sequence[str]) -> DataFrame:
    """Per entity column: earlier positives with the value, when it was first seen, and how long ago."""
    out = []
    for e in entities:
        known = F.col(e).isNotNull()
        positives = F.coalesce(F.sum(F.coalesce(F.col(roles.target), F.lit(0)).cast("long")).over(prior(roles, e)), F.lit(0)) if roles.target in df.columns else F.lit(0)
        first = F.when(known, F.min(roles.time).over(Window.partitionBy(e)))
        out += [F.when(known, positives).otherwise(0).cast("long").alias(f"{e}_fraud_count"), first.alias(f"{e}_first_seen_dt"), (F.col(roles.time) - first).alias(f"{e}_time_since_first")]
    return df.select("*", *out)


def distinct_before(df: DataFrame, roles: Roles, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Per group of columns: how many values the key has met before this row; and their sum as diversity.

    A value counts where it occurs first; the flags are summed over the rows
    before, so no set of values is ever held.
    """
    key, out, flagged = roles.key, {}, df
    for name, columns in groups.items():
        flags = []
        for c in columns:
            first = F.row_number().over(Window.partitionBy(key, c).orderBy(roles.time, roles.id)) == 1
            flag = f"_new_{name}_{c}"
            flagged = flagged.withColumn(flag, (first & F.col(c).isNotNull()).cast("long"))
            flags.append(F.col(flag))
        out[f"{key}_unique_{name}"] = F.when(F.col(key).isNull(), 0).otherwise(F.coalesce(F.sum(sum(flags, F.lit(0))).over(prior(roles)), F.lit(0))).cast("long")
    counted = flagged.select(*df.columns, *[v.alias(k) for k, v in out.items()])
    return counted.withColumn(f"{key}_entity_diversity", sum((F.col(k) for k in out), F.lit(0)).cast("long"))


def component_size(df: DataFrame, roles: Roles, entities: Sequence[str], segment_rows: int = HUB_ROWS) -> DataFrame:
    """``component_size``: nodes in the key's component before the row's own edges are added; 1 for a new key, 0 without one.

    Rows are numbered in order, and an edge counts from its first row on.  The
    edges become a merge tree (:func:`chronolith.operators.components.merge_tree`):
    for each node but a component's last, which node speaks for it from when
    on.  A row looks up who speaks for its key, then sums what that node had
    taken in before.  Nothing is replayed, so the number of jobs does not grow
    with the rows, and no task holds a component: nodes with more than
    ``segment_rows`` edges are not one key of a join.
    """
    nodes = [roles.key, *entities]
    names = [F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(c), F.col(c).cast("string"))) for c in nodes]
    columns, order = df.columns, [F.col(roles.time).asc_nulls_last(), F.col(roles.id).asc_nulls_last()]
    # the number of a row is its place; so rows which repeat an id stay apart
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "graph-rows")
    listed = rows.select("_row", F.array_compact(F.array(*names)).alias("_nodes")).where(F.size("_nodes") > 1)
    pairs = listed.select((F.col("_row") * len(nodes)).alias("at"), F.col("_nodes")[0].alias("src"), F.posexplode("_nodes").alias("k", "dst")).where("src <> dst")
    edges = written(pairs.groupBy("src", "dst").agg(F.min(F.col("at") + F.col("k")).alias("at")), "graph-edges")
    named, tree = merge_tree(edges, segment_rows)
    chains, weights = ancestors(tree, segment_rows)
    heads = named.join(chains.withColumnRenamed("node", "rank").hint("merge"), "rank", "left")
    asked = rows.select("_row", (F.col("_row") * len(nodes)).alias("at"), names[0].alias("node")).where("node is not null")
    # a key without edges is alone for ever
    held = F.try_element_at(F.filter("chain", lambda x: x["at"] < F.col("at")), F.lit(-1))["node"]
    placed = asked.join(heads.hint("merge"), "node", "left").select("_row", "at", F.coalesce(held, F.col("rank")).alias("head"))
    taken = tree.join(weights.hint("merge"), "node").select(F.lit(None).cast("long").alias("_row"), "at", F.col("parent").alias("head"), "weight")
    both = written(placed.where("head is not null").withColumn("weight", F.lit(0).cast("long")).unionByName(taken), "graph-sizes")
    summed = prior_aggregates(both, Roles("head", "at", "_row", "weight"), [["head"]], stats=["sum"])
    sizes = summed.where("_row is not null").select("_row", (F.col("head_weight_sum").cast("long") + 1).alias("component_size"))
    known = F.when(F.col(roles.key).isNull(), 0).otherwise(F.coalesce("component_size", F.lit(1)))
    # by a sort, as everywhere here: there is a size for each row, and what is broadcast goes through the driver
    return rows.join(sizes.hint("merge"), "_row", "left").select(*columns, known.cast("long").alias("component_size"))
