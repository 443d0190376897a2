import math

import pytest
from comparing import rows
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from rarelabel.operators.encode import assemble
from rarelabel.operators.resample import oversample
from rarelabel.operators.split import with_cell, with_fold
from rarelabel.plans import learners, tuning


@pytest.fixture(scope="module")
def vectors(spark):
    i = F.col("id")
    df = spark.range(240).select(
        "id",
        (i % 4 == 0).cast("double").alias("label"),
        (i % 4 + (i * 7 % 5) / 2).cast("double").alias("a"),
        (i * 11 % 13).cast("double").alias("b"),
    )
    return assemble(df, ["a", "b"], keep=["id"]).cache()


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.7,)], "p double")
    assert rows(df.select(learners.above_threshold(F.col("p"), 0.5).alias("x"))) == [(0.0,), (0.0,), (1.0,)]


def test_regression_beats_a_constant_and_repeats(vectors):
    fit = lambda: learners.logistic_regression(regParam=0.01).fit(vectors).transform(vectors)
    p = F.col("label") * F.log(learners.class_probability()) + (1 - F.col("label")) * F.log(1 - learners.class_probability())
    loss = -fit().agg(F.avg(p)).first()[0]
    assert loss < -(0.25 * math.log(0.25) + 0.75 * math.log(0.75))
    assert rows(fit(), "id", "prediction") == rows(fit(), "id", "prediction")


def test_stored_weights_score_like_the_model(vectors):
    from pyspark.ml.functions import vector_to_array

    model = learners.logistic_regression().fit(vectors)
    x = vector_to_array("features")
    ours = learners.linear_score(list(model.coefficients), model.intercept, [x[0], x[1]])
    both = model.transform(vectors).select(ours.alias("p"), learners.class_probability().alias("q"))
    assert both.filter(F.abs(F.col("p") - F.col("q")) > 1e-12).count() == 0


def test_coefficient_tables(spark, vectors):
    binary = learners.coefficient_table(spark, learners.logistic_regression().fit(vectors), ["a", "b"])
    assert rows(binary, "class", "pos", "name") == [(1, 0, "a"), (1, 1, "b")]
    many = learners.multinomial_regression(maxIter=5).fit(vectors.withColumn("label", F.col("id") % 3))
    full, pivot = (learners.coefficient_table(spark, many, ["a", "b"], pivot=p) for p in (False, True))
    assert full.count() == 6 and pivot.count() == 4
    weight = {(r["class"], r.pos): r.weight for r in full.collect()}
    assert all(r.weight == pytest.approx(weight[(r["class"], r.pos)] - weight[(0, r.pos)]) for r in pivot.collect())


def test_forest_is_judged_on_decoded_labels(spark, vectors):
    df = vectors.withColumn("label", F.when(F.col("label") == 1, "rare").otherwise("common"))
    labels = learners.fit_label_index(df).labels
    assert list(labels) == ["common", "rare"]
    model = learners.forest_pipeline(labels, seed=3, trees=5).fit(df)
    out = model.transform(df)
    assert {r.predictedLabel for r in out.select("predictedLabel").distinct().collect()} <= {"common", "rare"}
    wrong = out.filter((F.col("prediction") == F.col("indexedLabel")) != (F.col("predictedLabel") == F.col("label")))
    assert wrong.count() == 0
    assert learners.importance_table(spark, model.stages[2], ["a", "b"]).count() == 2
    assert learners.forest_table(spark, model.stages[2]).count() == 5


def test_perceptron_layers_and_seed(vectors):
    model = learners.perceptron([2, 4, 2]).fit(vectors)
    assert list(model.getLayers()) == [2, 4, 2]
    again = learners.perceptron([2, 4, 2]).fit(vectors)
    assert rows(model.transform(vectors), "id", "prediction") == rows(again.transform(vectors), "id", "prediction")


def test_saved_model_scores_the_same(spark, vectors, tmp_path):
    model = Pipeline(stages=[learners.naive_bayes()]).fit(vectors)
    for _ in range(2):
        learners.save_model(model, str(tmp_path / "m"))
    back = learners.load_model(str(tmp_path / "m"))
    assert rows(back.transform(vectors), "id", "prediction") == rows(model.transform(vectors), "id", "prediction")
    found = dict((r.param, r.value) for r in learners.parameter_table(spark, model).collect())
    assert found["smoothing"] == "1.0" and found["modelType"] == "multinomial"
    assert len(learners.scored_rows(model.transform(vectors), ["id"]).first().probability) == 2


def test_empty_grid_has_one_candidate():
    assert tuning.param_grid() == [{}]


def test_library_cross_validator_uses_given_folds(vectors):
    folded = with_fold(vectors, "id", 3, 1)
    lr = learners.logistic_regression()
    grid = tuning.param_grid({lr.regParam: [0.01, 1.0]})
    model = tuning.cross_validator(lr, BinaryClassificationEvaluator(numBins=0), grid, 3, "fold").fit(folded)
    ours = tuning.cross_validate(folded, lr, BinaryClassificationEvaluator(numBins=0), grid, 3)
    means = {r.params: r.m for r in ours.groupBy("params").agg(F.avg("metric").alias("m")).collect()}
    for params, metric in zip(grid, model.avgMetrics):
        assert means[tuning.describe(params)] == pytest.approx(metric)


def test_resampling_touches_training_rows_only(vectors):
    folded = with_fold(vectors, "id", 3, 1)
    seen = []

    def resample(train):
        seen.append({r.fold for r in train.select("fold").distinct().collect()})
        return oversample(train, "label", "id", 2)

    net = learners.perceptron([2, 2])
    out = tuning.cross_validate(folded, net, MulticlassClassificationEvaluator(), tuning.param_grid({net.maxIter: [2, 3]}), 3, resample=resample)
    assert seen == [{1, 2}, {0, 2}, {0, 1}]
    assert out.count() == 6 and rows(out.select("part").distinct()) == [(0,), (1,), (2,)]


def test_gridding_the_category_limit_refits_it(spark, vectors):
    df = vectors.withColumn("label", F.col("label").cast("string"))
    forest = learners.forest_pipeline(["0.0", "1.0"], seed=1, trees=2)
    indexer = forest.getStages()[1]
    few, many = (forest.fit(df, {indexer.maxCategories: m}).stages[1] for m in (2, 30))
    assert len(few.categoryMaps) < len(many.categoryMaps)


def test_best_params_and_ties(spark):
    df = spark.createDataFrame(
        [("b", 0, 0.3), ("b", 1, 0.6), ("a", 0, 0.6), ("a", 1, 0.3), ("c", 0, 0.1)], tuning.RESULT
    )
    assert rows(tuning.best_params(df), "params") == [("a",)]
    assert rows(tuning.best_params(df, larger_is_better=False), "params") == [("c",)]


def test_repeated_holdout_and_summary(vectors):
    rows_in = with_cell(vectors, "id", 64, 1)
    result = tuning.repeated_holdout(
        rows_in, learners.logistic_regression(), {"auc": BinaryClassificationEvaluator(numBins=0)}, rounds=3, seed=1
    )
    assert rows(result, "round", "metric") == [(0, "auc"), (1, "auc"), (2, "auc")]
    summary = tuning.summarize(result, ["metric"]).first()
    values = sorted(v for (v,) in rows(result, "value"))
    assert summary.n == 3 and summary.median == pytest.approx(values[1]) and summary.stddev > 0


def test_held_table_is_released(spark, vectors):
    df = vectors.select("id")
    with learners.held_in_memory(df) as held:
        assert held.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def test_selection_is_fitted_inside_each_fold(spark, tmp_path):
    from rarelabel.plans.selection import TopChiSquare

    i = F.col("id")
    df = spark.range(90).select(
        "id",
        (i % 2).cast("double").alias("label"),
        (i % 3).cast("double").alias("noise"),
        (i % 2 * 4).cast("double").alias("good"),
    )
    rows_in = with_fold(assemble(df, ["noise", "good"], keep=["id"]), "id", 3, 1)
    pick = TopChiSquare(k=1)
    steps = Pipeline(stages=[pick, learners.logistic_regression(featuresCol="selected", regParam=0.01)])
    model = steps.fit(rows_in)
    assert model.stages[0].getIndices() == [1]
    learners.save_model(model, str(tmp_path / "m"))
    assert learners.load_model(str(tmp_path / "m")).stages[0].getIndices() == [1]
    out = tuning.cross_validate(rows_in, steps, BinaryClassificationEvaluator(), tuning.param_grid({pick.k: [1, 2]}), 3)
    assert out.count() == 6 and out.filter("metric < 0.99").count() == 0
