import pytest
from comparing import rows
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rarelabel.operators import forest
from rarelabel.operators.split import with_fold
from rarelabel.plans import forests, learners


@pytest.fixture(scope="module")
def table(spark):
    """Three classes; the first feature is a category, the others are numbers."""
    i = F.col("id")
    draw = lambda n, m: F.pmod(F.xxhash64(i, F.lit(n)), F.lit(m)).cast("double")
    df = spark.range(600).select("id", draw(1, 6).alias("a"), (draw(2, 997) / 100).alias("b"), (draw(3, 1013) / 77).alias("c"))
    kind = F.when((F.col("a") % 2 == 0) & (F.col("b") > 4), "x").when(F.col("c") + draw(4, 5) > 9, "y").otherwise("z")
    return df.select("id", kind.alias("label"), array_to_vector(F.array("a", "b", "c")).alias("features")).cache()


@pytest.fixture(scope="module")
def fitted(spark, table):
    labels = learners.fit_label_index(table).labels
    model = learners.forest_pipeline(labels, 3, 7, 8).fit(table)
    return labels, model, forest.node_table(spark, model.stages[2]), model.transform(table)


def test_nodes_are_those_of_the_model(fitted):
    _, model, nodes, _ = fitted
    assert rows(nodes.groupBy("tree").count()) == [(k, t.numNodes) for k, t in enumerate(model.stages[2].trees)]
    assert rows(nodes.groupBy("tree").agg(F.max("depth"))) == [(k, t.depth) for k, t in enumerate(model.stages[2].trees)]
    assert nodes.where("categories is not null").count() and nodes.where("threshold is not null").count()
    assert nodes.where("length(path) <> depth or (feature is null) <> (left is null)").count() == 0
    assert nodes.select("tree", "path").distinct().count() == nodes.count()


def test_votes_are_those_of_the_library(fitted):
    _, _, nodes, scored = fitted
    ours = forest.votes(scored.select("id", "indexedFeatures"), nodes, ["id"], "indexedFeatures")
    both = scored.select("id", vector_to_array("rawPrediction").alias("raw"), F.col("prediction").alias("theirs")).join(ours, "id")
    assert both.where("raw <> votes or theirs <> prediction").count() == 0 and both.count() == 600


def test_large_forests_are_joined_by_shuffle(fitted, monkeypatch):
    _, _, nodes, scored = fitted
    want = rows(forest.leaves(scored, nodes, ["id"], "indexedFeatures"), "id", "tree", "node")
    monkeypatch.setattr(forest, "BROADCAST_NODES", 3)
    assert rows(forest.leaves(scored, nodes, ["id"], "indexedFeatures"), "id", "tree", "node") == want and len(want) == 7 * 600


def test_first_trees_are_a_smaller_forest(fitted):
    _, _, nodes, scored = fitted
    sized = forest.votes(scored, nodes, ["id"], "indexedFeatures", [1, 3, 7])
    few = forest.votes(scored, nodes.where("tree < 3"), ["id"], "indexedFeatures")
    assert rows(sized.where("size = 3").select("id", "prediction")) == rows(few.select("id", "prediction"))
    assert rows(sized.groupBy("size").count()) == [(1, 600), (3, 600), (7, 600)]


def test_importances_and_sums(spark, fitted):
    _, model, nodes, _ = fitted
    ours = [v for _, v in rows(forest.importances(nodes, 3))]
    assert ours == pytest.approx(model.stages[2].featureImportances.toArray().tolist())
    assert forest.unsound_nodes(nodes).count() == 0
    bent = nodes.withColumn("counts", F.when((F.col("tree") == 1) & (F.col("depth") == 1), F.transform("counts", lambda c: c + 1)).otherwise(F.col("counts")))
    assert {r.tree for r in forest.unsound_nodes(bent).collect()} == {1}


def test_rows_may_have_columns_called_tree_and_node(fitted):
    _, _, nodes, scored = fitted
    named = scored.select(F.col("id").alias("tree"), F.lit(5).alias("node"), F.lit("c").alias("counts"), "indexedFeatures")
    ours = forest.votes(named, nodes, ["tree"], "indexedFeatures")
    want = rows(scored, "id", "prediction")
    assert rows(ours, "tree", "prediction") == want


def test_a_single_leaf(spark, table):
    only = table.where("label = 'x'")
    model = learners.forest_pipeline(["x", "y"], 1, 2, 3).fit(only)
    nodes = forest.node_table(spark, model.stages[2])
    judged = forest.votes(PipelineModel(model.stages[:2]).transform(only), nodes, ["id"], "indexedFeatures")
    assert nodes.count() == 2 and {r.prediction for r in judged.collect()} == {0.0}


def test_sizes_are_judged_on_held_out_rows(table, fitted):
    labels = fitted[0]
    folded = with_fold(table, "id", 3, 2)
    seen = []

    def resample(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        return train

    found = forests.forest_sizes(folded, labels, "id", [1, 4], [3, 8], 3, 5, resample=resample)
    assert seen == [{1, 2}, {0, 2}, {0, 1}] and found.count() == 12
    model = learners.forest_pipeline(labels, 5, 4, 8).fit(folded.where("fold <> 1"))
    f1 = MulticlassClassificationEvaluator(labelCol="indexedLabel", metricName="f1").evaluate(model.transform(folded.where("fold = 1")))
    assert found.where("part = 1 and params = 'maxCategories=8, numTrees=4'").first().metric == pytest.approx(f1)
