"""Forests as tables of nodes, and scoring by joins of rows with nodes.

A fitted forest of ``pyspark.ml`` becomes rows ``(tree, node, ...)``.  Rows of data
start at the root of every tree and move down one level with each join; leaves
give class shares, which are added up in the order of the trees, as the library
does.  Since the votes of a row are kept by tree, a forest of the first k trees is
judged from running sums, without another fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import ensure_checkpoint_dir, remove_path, scratch_path

BROADCAST_NODES = 200_000


def node_table(spark: SparkSession, model) -> DataFrame:
    """``(tree, node, depth, path, prediction, impurity, counts, rows, gain, left, right, feature, threshold, categories)``.

    ``model`` is a fitted forest, not a pipeline.  A leaf has null ``feature``; an
    inner node sends a row to ``left`` if its feature is at most ``threshold`` or,
    for a categorical feature, one of ``categories``.  ``counts`` are the training
    rows of each class, weighted as they were drawn; ``path`` is the way from the
    root in L and R.  The nodes are read from the model's stored form.
    """
    ensure_checkpoint_dir(spark)
    folder = scratch_path(spark, "forest")
    model.write().save(folder)
    raw = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    plain = F.col("split.numCategories") < 0
    nodes = raw.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), "prediction", "impurity", F.col("impurityStats").alias("counts"), F.col("rawCount").alias("rows"),
        F.when(inner, F.col("gain")).alias("gain"), F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"), F.when(inner & plain, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner & ~plain, F.col("split.leftCategoriesOrThreshold")).alias("categories"),
    ).checkpoint(eager=True)
    remove_path(spark, folder)
    # one join per level of the deepest tree
    level = nodes.where("node = 0").select("tree", "node", F.lit(0).alias("depth"), F.lit("").alias("path"))
    placed = level
    for _ in range(max((t.depth for t in model.trees), default=0)):
        parents = level.join(nodes.select("tree", "node", "left", "right"), ["tree", "node"]).where("left is not null")
        sides = F.array(*[F.struct(F.col(side).alias("node"), F.lit(mark).alias("mark")) for side, mark in (("left", "L"), ("right", "R"))])
        level = parents.select("tree", "depth", "path", F.inline(sides)).select("tree", "node", (F.col("depth") + 1).alias("depth"), F.concat("path", "mark").alias("path"))
        placed = placed.unionByName(level)
    return nodes.join(placed, ["tree", "node"]).select("tree", "node", "depth", "path", *nodes.columns[2:]).checkpoint(eager=True)


def _values(df: DataFrame, features: str) -> Column:
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features)


def leaves(df: DataFrame, nodes: DataFrame, key: Sequence[str], features: str = "features") -> DataFrame:
    """``(key..., tree, node, counts)``: the leaf of every row in every tree."""
    return _leaves(df, nodes, key, features).select("_key.*", "tree", "node", "counts")


def _leaves(df: DataFrame, nodes: DataFrame, key: Sequence[str], features: str = "features") -> DataFrame:
    """``(_key, tree, node, counts)``, the key as one value.

    While there are at most ``BROADCAST_NODES`` nodes they are sent to
    the rows, and no row is shuffled; larger forests are joined by tree and node.
    """
    trees, deepest, size = nodes.agg(F.max("tree"), F.max("depth"), F.count(F.lit(1))).first()
    around = (lambda t: F.broadcast(t)) if size <= BROADCAST_NODES else (lambda t: t)
    steps = nodes.select("tree", "node", "feature", "threshold", "categories", "left", "right")
    # names of their own: rows may have columns called tree or node
    rows = df.select(F.struct(*key).alias("_key"), _values(df, features).alias("_x"))
    at = rows.select("_key", "_x", F.explode(F.sequence(F.lit(0), F.lit(trees))).alias("tree")).withColumn("node", F.lit(0))
    for _ in range(deepest):
        value = F.element_at("_x", F.col("feature") + 1)
        goes_left = F.when(F.col("categories").isNull(), value <= F.col("threshold")).otherwise(F.array_contains("categories", value))
        ahead = F.when(F.col("feature").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = at.join(around(steps), ["tree", "node"]).select("_key", "_x", "tree", ahead.alias("node"))
    return at.join(around(nodes.select("tree", "node", "counts")), ["tree", "node"]).select("_key", "tree", "node", "counts")


def votes(df: DataFrame, nodes: DataFrame, key: Sequence[str], features: str = "features", sizes: Sequence[int] | None = None) -> DataFrame:
    """``(key..., size, votes, prediction)`` by the first ``size`` trees, for each of ``sizes`` (all trees if not given).

    A tree adds the class shares of the row's leaf; the first of the largest
    classes wins.  ``key`` must tell rows apart.
    """
    sizes = list(sizes) if sizes is not None else [nodes.agg(F.max("tree")).first()[0] + 1]
    found = _leaves(df, nodes, key, features)
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    share = F.when(total != 0, F.transform("counts", lambda c: c / total)).otherwise(F.col("counts"))
    held = found.select("_key", F.struct("tree", share.alias("share")).alias("_vote"))
    # as many votes a row as the forest has trees
    gathered = held.groupBy("_key").agg(F.array_sort(F.collect_list("_vote")).alias("_votes"))
    nothing = F.transform(F.get("_votes", F.lit(0))["share"], lambda c: F.lit(0.0))
    added = lambda n: F.aggregate(F.slice("_votes", 1, n), nothing, lambda a, v: F.zip_with(a, v["share"], lambda x, y: x + y))
    each = F.array(*[F.struct(F.lit(n).alias("size"), added(n).alias("votes")) for n in sizes])
    winner = (F.array_position("votes", F.array_max("votes")) - 1).cast("double").alias("prediction")
    return gathered.select("_key", F.inline(each)).select("_key.*", "size", "votes", winner)


def importances(nodes: DataFrame, width: int) -> DataFrame:
    """``(pos, importance)``: gain times rows, as shares of each tree, averaged and brought to the sum 1."""
    rows = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c)
    by_tree = nodes.where("feature is not null").groupBy("tree", F.col("feature").alias("pos")).agg(F.sum(F.col("gain") * rows).alias("v"))
    # a few features a tree, then a few features
    shares = by_tree.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("tree")))
    summed = shares.groupBy("pos").agg(F.sum("v").alias("v"))
    whole = summed.agg(F.sum("v").alias("whole"))
    every = nodes.sparkSession.range(width).select(F.col("id").cast("int").alias("pos"))
    return every.join(summed, "pos", "left").join(F.broadcast(whole)).select("pos", F.coalesce(F.col("v") / F.col("whole"), F.lit(0.0)).alias("importance"))


def unsound_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose children do not add up: to the rows of each class, or to the stated gain.

    Empty for a forest as it was grown with the Gini impurity.
    """
    gini = lambda c: 1.0 - F.aggregate(F.transform(c, lambda v: v / _sum(c)), F.lit(0.0), lambda a, s: a + s * s)
    child = nodes.select("tree", "node", "counts", "rows")
    left, right = (child.select("tree", F.col("node").alias(side), F.col("counts").alias(f"{side}_counts"), F.col("rows").alias(f"{side}_rows")) for side in ("left", "right"))
    both = nodes.where("feature is not null").join(left, ["tree", "left"]).join(right, ["tree", "right"])
    added = F.zip_with("left_counts", "right_counts", lambda a, b: a + b)
    off = F.exists(F.zip_with("counts", added, lambda a, b: F.abs(a - b)), lambda d: d > 1e-6)
    gain = gini("counts") - _sum("left_counts") / _sum("counts") * gini("left_counts") - _sum("right_counts") / _sum("counts") * gini("right_counts")
    return both.where(off | (F.col("rows") != F.col("left_rows") + F.col("right_rows")) | (F.abs(gain - F.col("gain")) > 1e-9)).select("tree", "node")


def _sum(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
