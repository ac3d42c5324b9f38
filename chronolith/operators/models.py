"""Classifiers on pyspark.ml, calibration, comparison, and reports on trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators import metrics
from chronolith.operators.selection import assembled
from chronolith.storage import written

#: Node tables of more rows than this are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Values, rows times columns, that a task of a training run holds; trees keep some 15 bytes of cached memory for each.
TASK_VALUES = 16_000_000


def make_model(kind: str, seed: int = 42, **params):
    """An estimator by name: ``lr``, ``gbt`` or ``random_forest``; other names are an error."""
    if kind == "lr":
        return LogisticRegression(**{"maxIter": 50, "regParam": 1e-4} | params)
    if kind == "gbt":
        return GBTClassifier(**{"maxIter": 20, "maxDepth": 4, "seed": seed} | params)
    if kind == "random_forest":
        return RandomForestClassifier(**{"numTrees": 20, "maxDepth": 6, "seed": seed} | params)
    raise ValueError(f"unknown model type {kind!r}: lr, gbt or random_forest")


@dataclass
class Classifier:
    """A fitted model with the columns it reads, in order."""

    columns: list[str]
    model: object

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        """``df`` with the probability of the positive class; absent columns count as 0."""
        present = df.select("*", *[F.lit(0.0).alias(c) for c in self.columns if c not in df.columns])
        scored = self.model.transform(assembled(present, self.columns, "_features"))
        return scored.select(*df.columns, vector_to_array("_probability")[1].alias(output))

    def importance(self, spark) -> DataFrame:
        """``(feature, importance)`` of a tree model."""
        values = self.model.featureImportances.toArray()
        return spark.createDataFrame([(c, float(v)) for c, v in zip(self.columns, values, strict=True)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, path: str) -> None:
        PipelineModel([self.model]).write().overwrite().save(path)


def dealt(rows: DataFrame, n: int, width: int) -> DataFrame:
    """``n`` rows of ``width`` values in so many partitions that a task has :data:`TASK_VALUES` at most.

    Compressed files are split by bytes, so a split may hold any number of rows,
    and training keeps them decompressed.  What one task may hold is left as it is.
    """
    tasks = -(-n * max(1, width) // TASK_VALUES)
    return rows if tasks <= 1 else rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism))


def fit(df: DataFrame, columns: Sequence[str], target: str, kind: str = "gbt", balance: bool = False, **params) -> Classifier:
    """Fit on rows with a target; ``balance`` weighs positives by the class ratio."""
    known = df.where(F.col(target).isNotNull())
    weight = F.lit(1.0)
    if balance:
        ratio = metrics.class_balance(known, target).first()["pos_weight"]
        weight = F.when(F.col(target) == 1, float(ratio)).otherwise(1.0)
    rows = assembled(known, columns, "_features").select("_features", F.col(target).cast("double").alias("_label"), weight.alias("_weight"))
    estimator = make_model(kind, **params).setFeaturesCol("_features").setLabelCol("_label").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction").setWeightCol("_weight")
    return Classifier(list(columns), estimator.fit(dealt(rows, known.count(), len(columns))))


def evaluate(df: DataFrame, score: str, target: str) -> DataFrame:
    """One row: auc, ap, ks, brier, logloss, ece; the scores are made once."""
    df = written(df.select(score, target), "scores")
    out = metrics.roc_auc(df, score, target)
    for other in (metrics.average_precision(df, score, target), metrics.kolmogorov_smirnov(df, score, target), metrics.probability_metrics(df, score, target), metrics.calibration_error(df, score, target)):
        out = out.crossJoin(F.broadcast(other))
    return out


def compare(train: DataFrame, val: DataFrame, columns: Sequence[str], target: str, kinds: Sequence[str] = ("lr", "gbt", "random_forest")) -> DataFrame:
    """Each model's metrics on ``val``, best AUC first."""
    out = None
    for kind in kinds:
        row = evaluate(fit(train, columns, target, kind).score(val), "p", target).select(F.lit(kind).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("auc"), "model")


def best_model(comparison: DataFrame, metric: str = "auc") -> DataFrame:
    """The best row: least for brier, logloss and ece, else greatest."""
    column = F.col(metric)
    return comparison.orderBy(column if metric in ("brier", "logloss", "ece") else column.desc(), "model").limit(1)


def cross_validate(df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str], kind: str = "gbt", n_splits: int = 3, purge: int = 0, **params) -> DataFrame:
    """``(fold, auc)`` over purged time folds."""
    from chronolith.operators.tables import purged_folds

    folds, out = written(purged_folds(df, order, n_splits, purge), "folds"), None
    for k in range(1, n_splits + 1):
        own = folds.where(F.col("fold") == k)
        row = metrics.roc_auc(fit(own.where("not is_val"), columns, target, kind, **params).score(own.where("is_val")), "p", target).select(F.lit(k).alias("fold"), "auc")
        out = row if out is None else out.unionByName(row)
    return out


def search(df: DataFrame, columns: Sequence[str], target: str, order: Sequence[str], grid: Sequence[dict], kind: str = "gbt", n_splits: int = 2) -> tuple[dict, float]:
    """The parameters of ``grid`` with the best mean fold AUC."""
    scored = [(cross_validate(df, columns, target, order, kind, n_splits, **params).agg(F.avg("auc")).first()[0] or 0.0, k) for k, params in enumerate(grid)]
    best, k = max(scored, key=lambda s: (s[0], -s[1]))
    return dict(grid[k]), best


# --- calibration ---------------------------------------------------------------


@dataclass
class PlattCalibrator:
    """A logistic curve over the raw score, with the L2 penalty of C = 1."""

    slope: float
    intercept: float

    def transform(self, df: DataFrame, score: str, output: str = "calibrated") -> DataFrame:
        return df.withColumn(output, 1 / (1 + F.exp(-(F.lit(self.slope) * F.col(score) + F.lit(self.intercept)))))


def fit_platt(df: DataFrame, score: str, target: str) -> PlattCalibrator:
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    n = max(1, known.count())
    rows = assembled(known, [score], "features").select("features", F.col(target).cast("double").alias("label"))
    model = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-9).fit(rows)
    return PlattCalibrator(float(model.coefficients[0]), float(model.intercept))


@dataclass
class IsotonicCalibrator:
    """A monotone curve, linear between its knots and flat beyond them."""

    model: object

    def transform(self, df: DataFrame, score: str, output: str = "calibrated") -> DataFrame:
        model = self.model.setFeaturesCol("_s").setPredictionCol("_iso")
        moved = model.transform(df.withColumn("_s", F.col(score).cast("double")))
        return moved.select(*df.columns, F.least(F.greatest("_iso", F.lit(0.0)), F.lit(1.0)).alias(output))


def fit_isotonic(df: DataFrame, score: str, target: str) -> IsotonicCalibrator:
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.col(target).cast("double").alias("_y"))
    return IsotonicCalibrator(IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol="_p").fit(rows))


# --- trees ----------------------------------------------------------------------


def tree_nodes(classifier: Classifier, spark, path: str) -> DataFrame:
    """The node table of a saved tree ensemble: ``(tree_id, node_id, left, right, feature, threshold, gain, value, n, weight)``."""
    classifier.model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    names = F.array(*[F.lit(c) for c in classifier.columns])
    weights = F.array(*[F.lit(float(w)) for w in classifier.model.treeWeights])
    leaf = F.col("leftChild") < 0
    # a forest averages its trees' shares of the positive class, boosting adds up predictions
    forest = isinstance(classifier.model, RandomForestClassificationModel)
    stats = F.col("impurityStats")
    value = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if forest else F.col("prediction")
    if forest:
        weights = F.transform(weights, lambda w: w / len(classifier.model.treeWeights))
    return nodes.select(F.col("treeID").alias("tree_id"), F.col("id").alias("node_id"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.when(~leaf, F.element_at(names, F.col("split.featureIndex") + 1)).alias("feature"), F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"), "gain", value.alias("value"), F.col("rawCount").alias("n"), weights[F.col("treeID")].alias("weight"))


def tree_paths(nodes: DataFrame, max_depth: int = 30) -> DataFrame:
    """``(tree_id, leaf_id, depth, features, conditions, path_gain, value, n)``: each leaf's path from the root, level by level."""
    edges = nodes.where("left >= 0")
    step = F.concat(F.col("feature"), F.when(F.col("went_left"), F.lit(" <= ")).otherwise(F.lit(" > ")), F.round("threshold", 6).cast("string"))
    children = edges.select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array(F.struct(F.col("left").alias("child"), F.lit(True).alias("went_left")), F.struct(F.col("right").alias("child"), F.lit(False).alias("went_left")))).alias("c"), "feature", "threshold", "gain").select("tree_id", "parent", "c.child", "c.went_left", "feature", "threshold", "gain").select("*", step.alias("condition"))
    level = nodes.where("node_id = 0").select("tree_id", F.col("node_id").alias("at"), F.array().cast("array<string>").alias("conditions"), F.array().cast("array<string>").alias("features"), F.lit(0.0).alias("path_gain"))
    leaves = nodes.where("left < 0").select("tree_id", F.col("node_id").alias("leaf_id"), "value", "n")
    done = None
    for depth in range(max_depth + 1):
        ended = level.join(leaves, (level["tree_id"] == leaves["tree_id"]) & (level["at"] == leaves["leaf_id"])).select(level["tree_id"], "leaf_id", F.lit(depth).alias("depth"), F.array_distinct("features").alias("features"), "conditions", "path_gain", "value", "n")
        done = ended if done is None else done.unionByName(ended)
        level = level.join(children, (level["tree_id"] == children["tree_id"]) & (level["at"] == children["parent"])).select(level["tree_id"], F.col("child").alias("at"), F.concat("conditions", F.array("condition")).alias("conditions"), F.concat("features", F.array("feature")).alias("features"), (F.col("path_gain") + F.col("gain")).alias("path_gain"))
        if depth % 4 == 3 and level.isEmpty():
            break
    return done


def tree_rules(paths: DataFrame, per_tree: int = 5, min_support: int = 0) -> DataFrame:
    """The strongest rules of each tree by path gain: conjunction, probability, support."""
    from pyspark.sql import Window

    ranked = paths.where(F.col("n") >= min_support).withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("path_gain"), "leaf_id")))
    return ranked.where(F.col("rank") <= per_tree).select("tree_id", "rank", F.array_join("conditions", " AND ").alias("rule"), (1 / (1 + F.exp(-2 * F.col("value")))).alias("probability"), F.col("n").alias("support"), "path_gain")


def tree_depths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per feature: splits, share of trees, and how deep its paths are."""
    trees = nodes.agg(F.count_distinct("tree_id").alias("trees"))
    splits = nodes.where("left >= 0").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.count_distinct("tree_id").alias("in_trees"), F.sum("gain").alias("gain"))
    deep = paths.select(F.explode("features").alias("feature"), "depth").groupBy("feature").agg(F.avg("depth").alias("avg_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    return splits.join(deep, "feature").crossJoin(F.broadcast(trees)).select("feature", "splits", (F.col("in_trees") / F.col("trees")).alias("tree_share"), "gain", "avg_depth", "min_depth", "max_depth")


def node_depths(nodes: DataFrame, max_depth: int = 30) -> DataFrame:
    """``(tree_id, node_id, depth)``: how far each node is from its root, level by level."""
    children = nodes.where("left >= 0").select("tree_id", F.col("node_id").alias("parent"), F.explode(F.array("left", "right")).alias("node_id"))
    level = nodes.where("node_id = 0").select("tree_id", "node_id", F.lit(0).alias("depth"))
    done = level
    for depth in range(1, max_depth + 1):
        level = level.select("tree_id", F.col("node_id").alias("parent")).join(children, ["tree_id", "parent"]).select("tree_id", "node_id", F.lit(depth).alias("depth"))
        done = done.unionByName(level)
        if depth % 4 == 0 and level.isEmpty():
            break
    return done


def depth_report(nodes: DataFrame) -> DataFrame:
    """Per feature, where in the trees it splits: ``splits, tree_share, avg_depth, min_depth, max_depth`` and ``depths``, splits by depth from the root."""
    split = nodes.where("left >= 0").join(node_depths(nodes), ["tree_id", "node_id"]).select("tree_id", "feature", "depth")
    trees = nodes.agg(F.count_distinct("tree_id").alias("trees"))
    by_depth = split.groupBy("feature", "depth").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("depth", "n")))).alias("depths"))
    whole = split.groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.count_distinct("tree_id").alias("in_trees"), F.avg("depth").alias("avg_depth"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    return whole.join(by_depth, "feature").crossJoin(F.broadcast(trees)).select("feature", "splits", (F.col("in_trees") / F.col("trees")).alias("tree_share"), "avg_depth", "min_depth", "max_depth", "depths").orderBy(F.desc("splits"), "feature")


def tree_summary(nodes: DataFrame, top: int = 10) -> DataFrame:
    """One row for an ensemble: trees, leaves, depths, total gain, features used, and the ``top`` features by gain with their share of it."""
    deep = nodes.join(node_depths(nodes), ["tree_id", "node_id"])
    leaves = deep.where("left < 0").agg(F.count_distinct("tree_id").alias("trees"), F.count(F.lit(1)).alias("leaves"), F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_leaf_depth"))
    gains = deep.where("left >= 0").groupBy("feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    whole = gains.agg(F.coalesce(F.sum("splits"), F.lit(0)).alias("splits"), F.coalesce(F.sum("gain"), F.lit(0.0)).alias("total_gain"), F.count(F.lit(1)).alias("features_used"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("order"), "feature", "gain"))), 1, top).alias("best"))
    best = F.transform("best", lambda b: F.struct(b["feature"].alias("feature"), b["gain"].alias("gain"), F.try_divide(b["gain"], F.col("total_gain")).alias("share")))
    return leaves.crossJoin(F.broadcast(whole)).withColumn("top_features", best).drop("best")


def tree_interactions(paths: DataFrame, min_paths: int = 10, top: int = 30) -> DataFrame:
    """Pairs of features that share paths."""
    one = paths.select("tree_id", "leaf_id", "path_gain", F.explode("features").alias("feature_1"))
    two = paths.select("tree_id", "leaf_id", F.explode("features").alias("feature_2"))
    pairs = one.join(two, ["tree_id", "leaf_id"]).where("feature_1 < feature_2")
    return pairs.groupBy("feature_1", "feature_2").agg(F.count(F.lit(1)).alias("paths"), F.avg("path_gain").alias("avg_gain")).where(F.col("paths") >= min_paths).orderBy(F.desc("paths"), "feature_1", "feature_2").limit(top)


def _walk(nodes: DataFrame, rows: DataFrame, id: str, max_depth: int) -> list[DataFrame]:
    """Where each row stands in each tree, one table a level; null features count as 0.

    The node table has a row for each node of the ensemble; up to ``BROADCAST_NODES`` of them are sent to all tasks.
    """
    features = [r[0] for r in nodes.where("feature is not null").select("feature").distinct().collect()]
    pairs = [x for c in features for x in (F.lit(c), F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0))]
    values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    small = nodes.select("tree_id", "node_id", "left", "right", "feature", "threshold", "value", "weight")
    if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        small = F.broadcast(small)
    start = rows.select(F.col(id).alias("id"), values.alias("x"))
    levels = [start.crossJoin(small.where("node_id = 0"))]
    for _ in range(max_depth):
        at = levels[-1]
        went = F.when(F.col("x")[F.col("feature")] <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        moved = at.where("left >= 0").select("id", "x", F.col("tree_id").alias("_t"), went.alias("_n"), F.col("feature").alias("_from"), F.col("value").alias("_before"))
        levels.append(moved.join(small, (F.col("_t") == F.col("tree_id")) & (F.col("_n") == F.col("node_id"))).drop("_t", "_n"))
    return levels


def _depth(nodes: DataFrame) -> int:
    """How deep the deepest tree is."""
    return int(tree_paths(nodes).agg(F.max("depth")).first()[0] or 0)


def trace(nodes: DataFrame, rows: DataFrame, id: str) -> DataFrame:
    """``(id, tree_id, leaf_id, depth, value)``: where each row ends in each tree."""
    done = None
    for depth, at in enumerate(_walk(nodes, rows, id, _depth(nodes))):
        ended = at.where("left < 0").select("id", "tree_id", F.col("node_id").alias("leaf_id"), F.lit(depth).alias("depth"), (F.col("value") * F.col("weight")).alias("value"))
        done = ended if done is None else done.unionByName(ended)
    return done


def explain(nodes: DataFrame, rows: DataFrame, id: str) -> DataFrame:
    """``(id, feature, contribution)``: each step of a path credits its feature with the change in the node's value.

    With the weighted values of the roots, a row's contributions sum to its margin.
    """
    steps = None
    for at in _walk(nodes, rows, id, _depth(nodes))[1:]:
        step = at.select("id", F.col("_from").alias("feature"), ((F.col("value") - F.col("_before")) * F.col("weight")).alias("change"))
        steps = step if steps is None else steps.unionByName(step)
    if steps is None:
        return rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)[id]}, feature string, contribution double")
    return steps.groupBy("id", "feature").agg(F.sum("change").alias("contribution"))


def global_importance(explained: DataFrame) -> DataFrame:
    """``(feature, importance)``: the mean size of the contributions over the explained rows."""
    rows = explained.agg(F.count_distinct("id").alias("_rows"))
    return explained.groupBy("feature").agg(F.sum(F.abs("contribution")).alias("_sum")).crossJoin(F.broadcast(rows)).select("feature", (F.col("_sum") / F.col("_rows")).alias("importance")).orderBy(F.desc("importance"), "feature")
