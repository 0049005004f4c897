"""Fitted tree models as a table of nodes, and their scores and importances computed from it.

A model is one row per node: tree, its weight in the sum, node, feature and cut with the two
nodes behind it, or the value of a leaf. Scoring sends every row down all trees by joins with
that table, so scores can be checked, explained or taken up by anything that reads tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most nodes that a model may have to be broadcast; a fitted model here has at most 50 trees of 63 nodes.
BROADCAST_NODES = 1_000_000


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of the trees of a saved pipeline, whose last stage is the tree model.

    Columns: tree, tree_weight, node, feature (its place among the model's inputs), cut, left,
    right, value, weight (of the training rows in the node), gain. Leaves have a null feature. The value of a
    node is what a boosted tree adds there, or the share of class 1 in a forest's node.
    """
    model = PipelineModel.load(path).stages[-1]
    at = f"{path}/stages/*_{model.uid}"
    trees = spark.read.parquet(f"{at}/treesMetadata").toDF("tree", "about", "tree_weight").select("tree", "tree_weight")
    forest = hasattr(model, "numClasses")
    nodes = spark.read.parquet(f"{at}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    inner = F.col("leftChild") >= 0
    nodes = nodes.select(
        "tree", F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("cut"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        (F.try_divide(stats[1], total) if forest else F.col("prediction")).alias("value"),
        (total if forest else stats[0]).alias("weight"), "gain",
    )
    # A forest's trees share its vote evenly.
    share = F.lit(1.0 / model.getNumTrees) if forest else F.col("tree_weight")
    return nodes.join(F.broadcast(trees), "tree").withColumn("tree_weight", share)


def depth_of(nodes: DataFrame) -> int:
    """Steps from a root to the deepest leaf."""
    inner = nodes.filter("feature IS NOT NULL")
    inner = inner.select(F.col("tree").alias("of"), F.col("node").alias("at"), F.array("left", "right").alias("children"))
    level = nodes.filter("node = 0").select("tree", "node")
    steps = 0
    while True:
        met = level.join(inner, (F.col("tree") == F.col("of")) & (F.col("node") == F.col("at")))
        level = met.select("tree", F.explode("children").alias("node"))
        if level.isEmpty():
            return steps
        steps += 1


def walked(rows: DataFrame, keys: Sequence[str], inputs: Sequence[str], nodes: DataFrame) -> DataFrame:
    """The keys and score of every row: the weighted sum of the leaves it reaches.

    Rows stay where they are on the way down; the sum then needs one exchange of one partial
    sum per row. Keys must be unique. A row with a null input has no score.
    """
    few = nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    behind = nodes.select(*[F.col(c).alias(f"n_{c}") for c in nodes.columns])
    if few:
        behind = F.broadcast(behind)
    last = nodes.agg(F.max("tree")).scalar()
    values = F.array(*[F.col(c).cast("double") for c in inputs])
    walk = rows.select(F.struct(*keys).alias("key"), values.alias("x")).select(
        "key", "x", F.explode(F.sequence(F.lit(0), last)).alias("tree"), F.lit(0).alias("node"), F.lit(None).cast("double").alias("value")
    )
    for _ in range(depth_of(nodes) + 1):
        met = walk.join(behind, (F.col("tree") == F.col("n_tree")) & (F.col("node") == F.col("n_node")), "left")
        goes_left = F.element_at("x", F.col("n_feature") + 1) <= F.col("n_cut")
        # A node without a feature is a leaf; rows already at one meet no node and keep its value.
        walk = met.select(
            "key", "x", "tree", F.when(goes_left, F.col("n_left")).when(~goes_left, F.col("n_right")).alias("node"),
            F.coalesce("value", F.when(F.col("n_feature").isNull(), F.col("n_tree_weight") * F.col("n_value"))).alias("value"),
        )
    total = F.when(F.count(F.lit(1)) == F.count("value"), F.sum("value"))
    return walk.groupBy("key").agg(total.alias("score")).select("key.*", "score")


def importances_of(nodes: DataFrame, inputs: Sequence[str], per_tree: bool) -> DataFrame:
    """(input, importance): gain times weight, summed per input and scaled to 1.

    per_tree scales every tree to 1 first, as a forest does; a boosted model adds its trees as they are.
    """
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("gain"))
    if per_tree:
        sums = gains.groupBy(F.col("tree").alias("of")).agg(F.sum("gain").alias("all"))
        gains = gains.join(sums, F.col("tree") == F.col("of")).withColumn("gain", F.try_divide("gain", "all"))
    each = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    whole = each.agg(F.sum("gain").alias("whole"))
    names = nodes.sparkSession.createDataFrame(list(enumerate(inputs)), "place int, input string")
    joined = names.join(each, F.col("place") == F.col("feature"), "left").join(F.broadcast(whole))
    return joined.select("input", F.coalesce(F.try_divide("gain", "whole"), F.lit(0.0)).alias("importance"))
