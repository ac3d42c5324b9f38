"""Registered queries of models, selection, sequences, streams and the feature plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import binning, history, models, recurrent, search, selection, sequence, shapley, tables
from chronolith.plans import store, training
from chronolith.plans.catalog import HOUR_US, MONTH, _halves, _recent, query, rounded
from chronolith.plans.views import EVENTS_SQL, ORDERS, ORDERS_SQL, events, orders, scored_orders, sparse_orders, table
from chronolith.sources.tables import fitted_types
from chronolith.storage import new_path, written
from chronolith.streaming import folds, ordered, stateful


@query()
def chi_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = binning.chi_merge(sparse_orders(spark, sf_dir), "amt", "y")
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(edges)], "k int, edge double")


_LINES = "(select l_orderkey, l_quantity as q, l_extendedprice as e, l_discount as d, l_tax as x, l_quantity * 2 + l_tax as z from lineitem)"


@query(f"select round(corr(q, e), 9) as q_e, round(corr(q, d), 9) as q_d, round(1 / (1 - corr(q, e) * corr(q, e)), 6) as vif_q_e from {_LINES}")
def vif_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"))
    matrix = selection.correlation(lines, ["q", "e", "d"])
    values = selection.vif_of(matrix[:2, :2])
    return rounded(rounded(spark.createDataFrame([(float(matrix[0, 1]), float(matrix[0, 2]), float(values[0]))], "q_e double, q_d double, vif_q_e double"), 9, "q_e", "q_d"), 6, "vif_q_e")


@query()
def vif_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("x"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("z"))
    left, dropped = selection.filter_by_vif(lines, ["q", "e", "d", "x", "z"])
    return spark.createDataFrame([(c, True) for c in left] + [(c, False) for c, _ in dropped], "feature string, kept boolean")


@query()
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    return selection.drift(train, val, ["amt", "t"], "id")


@query()
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_orders(spark, sf_dir)
    platt = models.fit_platt(rows, "p", "y").transform(rows, "p", "platt")
    return models.fit_isotonic(rows, "p", "y").transform(platt, "p", "isotonic")


@query()
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    return models.compare(train, val, ["amt", "t"], "y", ["lr", "gbt", "random_forest"])


@query()
def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _halves(spark, sf_dir)
    classifier = models.fit(train, ["amt", "t"], "y", "gbt", maxIter=5, maxDepth=3)
    nodes = written(models.tree_nodes(classifier, spark, new_path(spark, "trees")), "nodes")
    return models.tree_rules(models.tree_paths(nodes))


@query()
def tree_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    classifier = models.fit(train, ["amt", "t"], "y", "gbt", maxIter=5, maxDepth=3)
    nodes = written(models.tree_nodes(classifier, spark, new_path(spark, "trees")), "nodes")
    return models.explain(nodes, val, "id")


@query()
def tree_shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    classifier = models.fit(train, ["amt", "t"], "y", "gbt", maxIter=5, maxDepth=3)
    nodes = written(models.tree_nodes(classifier, spark, new_path(spark, "trees")), "nodes")
    return shapley.strongest(shapley.shapley(nodes, val, "id"), 1).select("id", "base", "margin", F.get("reasons", 0)["feature"].alias("reason"))


@query()
def tree_depth_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _halves(spark, sf_dir)
    classifier = models.fit(train, ["amt", "t"], "y", "gbt", maxIter=5, maxDepth=3)
    nodes = written(models.tree_nodes(classifier, spark, new_path(spark, "trees")), "nodes")
    return models.depth_report(nodes).withColumn("depths", F.to_json("depths"))


@query()
def recurrent_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    return recurrent.fit(base, ORDERS, ["amt", "y"], length=12, hidden=8, epochs=5).transform(base, ORDERS, 12)


@query()
def parameter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _halves(spark, sf_dir)
    _, results = search.search(train, ["amt", "t"], "y", ["t", "id"], {"maxDepth": ("int", 1, 4)}, "random_forest", trials=2, budget=("numTrees", 2, 4), factor=2)
    return search.report(spark, results)


@query()
def train_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir).select("id", "key", "t", "amt", "y")
    steps = ["time", "amount", {"history": {"windows": [MONTH]}}, "velocity", {"uid": {"columns": ["key"]}}]
    trained = training.train(base, ORDERS, steps, maxIter=5, maxDepth=3)
    return trained.score(base).drop("scored_at")


@query(f"""with r as (select key, t, id, amt, row_number() over (partition by key order by t desc, id desc) as k from {ORDERS_SQL}) select key, count(*)::int as n, round(sum(amt * (8 - k)), 2) as weighed, max(case when k = 1 then amt end) as last_amt from r where k <= 5 group by key""")
def sequence_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = sequence.sequence_tail(orders(spark, sf_dir), ORDERS, ["amt"], 5)
    weighed = F.aggregate(F.transform(F.reverse("sequence"), lambda x, i: x[0] * (F.lit(7) - i)), F.lit(0.0), lambda s, v: s + v)
    return tail.select("key", "n", F.round(weighed, 2).alias("weighed"), F.element_at("sequence", -1)[0].alias("last_amt"))


@query()
def sequence_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    encoder = sequence.fit_encoder(base, ORDERS, ["amt", "y"], 6, 4)
    return sequence.join_embedding(base.select("id", "key"), encoder.transform(base, ORDERS), "key", 4)


@query("""with recursive e as (select 'c:' || c_custkey as name, 'n:' || n_name as source from customer join nation on c_nationkey = n_nationkey union all select 'n:' || n_name, 'r:' || r_name from nation join region on n_regionkey = r_regionkey),
up(source) as (select source from e where name = 'c:1' union select e.source from e join up on e.name = up.source) select source from up""")
def lineage_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nation.select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n:"), "n_name").alias("n"), "n_regionkey")
    low = table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("k")).select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("name"), F.col("n").alias("source_name"))
    high = names.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n").alias("name"), F.concat(F.lit("r:"), "r_name").alias("source_name"))
    return spark.createDataFrame([(s,) for s in store.upstream(low.unionByName(high), "c:1", True)], "source string")


_HOT = "from (select event_id as id, 1 as key, epoch_us(ts) as t, value as amt from events)"
_HOT_PRIOR = "over (order by t, id rows between unbounded preceding and 1 preceding)"


@query(f"select id, count(*) {_HOT_PRIOR} as n, round(coalesce(sum(amt) {_HOT_PRIOR}, 0), 3) as total, floor(coalesce(avg(amt) {_HOT_PRIOR}, 0) * 10000 + 0.3137)::bigint as mean_steps, round(coalesce(stddev_samp(amt) {_HOT_PRIOR}, 0), 3) as std, coalesce(min(amt) {_HOT_PRIOR}, 0) as lo, coalesce(max(amt) {_HOT_PRIOR}, 0) as hi {_HOT}")
def agg_prior_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events under one key: every expanding statistic, summed in chunks of a day; means in steps whose edges no mean of cents hits."""
    base = events(spark, sf_dir).withColumn("key", F.lit(1))
    found = history.prior_in_chunks(base, ORDERS, 24 * HOUR_US)
    named = found.select("id", F.col("key_amt_count").alias("n"), F.col("key_amt_sum").alias("total"), F.floor(F.col("key_amt_mean") * 10000 + 0.3137).cast("long").alias("mean_steps"), F.col("key_amt_std").alias("std"), F.col("key_amt_min").alias("lo"), F.col("key_amt_max").alias("hi"))
    return rounded(rounded(named, 3, "total"), 3, "std")


_HOT_HOUR, _HOT_TIED = f"over (order by t range between {HOUR_US} preceding and current row)", "over (partition by t order by id rows between current row and unbounded following)"


@query(f"select id, count(*) {_HOT_HOUR} - count(*) {_HOT_TIED} as n, round(coalesce(sum(amt) {_HOT_HOUR}, 0) - coalesce(sum(amt) {_HOT_TIED}, 0), 3) as total {_HOT}")
def history_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events under one key: the last hour of each, in chunks."""
    base = events(spark, sf_dir).withColumn("key", F.lit(1))
    found = history.history_in_chunks(base, ORDERS, HOUR_US, ["count", "sum"])
    return rounded(found.select("id", F.col(f"tx_count_last_{HOUR_US}s").alias("n"), F.col(f"amt_sum_last_{HOUR_US}s").alias("total")), 3, "total")


#: How late an event may come in the registered streams, in microseconds.
_LATE_US = 6 * HOUR_US


def _streamed(spark: SparkSession, df: DataFrame, make: Callable[[DataFrame, int], DataFrame], slices: int = 2) -> DataFrame:
    """What ``make``, of a stream and a number of buckets, gives for ``df`` (id, key, t, ...) as a stream that is stopped and started again, with late events.

    Rows come in ``slices`` of time, one run of the query each; every fifth of the rows in the last six
    hours of a slice comes with the next one.  A last row ends the stream.
    """
    ends = df.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    first, last = (ends[0] or 0), (ends[1] or 0)
    width = (last - first) // slices + 1
    # so that a bucket's share of the rows does not grow with them
    buckets = max(64, ends[2] // 10_000)
    held = (F.xxhash64("id") % 5 == 0) & ((F.col("t") - first) % width >= width - _LATE_US)
    arrives = F.floor((F.col("t") - first) / width) + held.cast("int")
    sliced = written(df.withColumns({"gone": F.lit(False), "arrives": arrives}), "arrivals")
    folder, sink, checkpoint = new_path(spark, "events"), new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    for k in range(slices + 1):
        part = sliced.where(F.col("arrives") == k).drop("arrives")
        if k == slices:
            blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
            end = spark.range(1).select(*blank).withColumns({"id": F.lit(-1).cast("long"), "key": F.lit(-1).cast(df.schema["key"].dataType), "t": F.lit(last + 10 * _LATE_US + width), "gone": F.lit(True)})
            part = part.unionByName(end)
        part.write.mode("append").parquet(folder)
        made = make(stateful.read_events(spark, folder, part.schema), buckets)
        made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(sink)


@query(f"select id, {_recent(24 * HOUR_US)} + 1 as n_recent from {EVENTS_SQL}")
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day, from a stream in several runs with late events."""
    base = events(spark, sf_dir).select("id", "key", "t")
    return _streamed(spark, base, lambda s, n: stateful.velocity_counts(s, ORDERS, 24 * HOUR_US, late="6 hours", tick="microsecond", reset="gone", buckets=n)).select("id", "n_recent")


_STREAM_PRIOR = "over (partition by key order by t, id rows between unbounded preceding and 1 preceding)"


@query(f"""select id, t - coalesce(lag(t) over (partition by key order by t, id), t) as time_since_last, count(*) {_STREAM_PRIOR} as n, round(coalesce(sum(amt) {_STREAM_PRIOR}, 0), 3) as total, coalesce(max(amt) {_STREAM_PRIOR}, 0) as hi,
{_recent(HOUR_US)} as n_hour, round(amt - coalesce(lag(amt) over (partition by key order by t, id), amt), 6) as amount_delta from {EVENTS_SQL}""")
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, aggregation and amount features of a stream in several runs with late events."""
    base = events(spark, sf_dir).select("id", "key", "t", "amt")
    made = [folds.History(ORDERS, [HOUR_US], ["count"]), folds.Aggregation(ORDERS, [["key"]], stats=["count", "sum", "max"]), folds.Amounts(ORDERS)]
    found = _streamed(spark, base, lambda s, n: ordered.in_order(s, ORDERS, made, "6 hours", "microsecond", reset="gone", buckets=n))
    return found.select("id", "time_since_last", F.col("key_amt_count").alias("n"), F.round("key_amt_sum", 3).alias("total"), F.col("key_amt_max").alias("hi"), F.col(f"tx_count_last_{HOUR_US}s").alias("n_hour"), F.round("amount_delta", 6).alias("amount_delta"))


@query(" union all ".join(f"select '{c}' as c, case when min({c}) >= -128 and max({c}) < 128 then 'tinyint' when min({c}) >= -32768 and max({c}) < 32768 then 'smallint' when max({c}) < 2147483648 then 'int' else 'bigint' end as dtype from orders" for c in ("o_orderkey", "o_custkey")))
def fitted_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = fitted_types(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in types], "c string, dtype string")


@query("select c_custkey as key, 'both' as side from (select c_custkey from customer intersect select o_custkey from orders) union all select c_custkey, 'customer' from (select c_custkey from customer except select o_custkey from orders)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    found = dict(tables.set_operations(left, right.distinct()))
    return found["intersection"].withColumn("side", F.lit("both")).unionByName(found["difference"].withColumn("side", F.lit("customer")))


@query("select c_custkey as key, case when c_custkey % 3 = 0 then 0.0 else c_acctbal end as v from customer union all select -1, 1.0")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    new = old.where("key % 3 = 0").select("key", F.lit(0.0).alias("v")).unionByName(spark.createDataFrame([(-1, 1.0)], "key long, v double"))
    return tables.upsert(old, new, ["key"])


@query("select event_type as kind, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("kind"), "value")
    found = stateful.windowed_totals(base, "ts", ["kind"], "value", "1 hour")
    return found.select("kind", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))

