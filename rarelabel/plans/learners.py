"""Learners of ``pyspark.ml`` with every setting that matters spelled out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@contextmanager
def held_in_memory(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a training table at hand while an iterative fit reads it again and again."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def logistic_regression(threshold: float = 0.5, **settings: Any) -> LogisticRegression:
    """Two classes, ridge penalty, standardised features."""
    chosen = {
        "featuresCol": "features",
        "labelCol": "label",
        "family": "binomial",
        "standardization": True,
        "regParam": 1.0,
        "elasticNetParam": 0.0,
        "threshold": threshold,
        "aggregationDepth": 2,
    }
    return LogisticRegression(**{**chosen, **settings})


def multinomial_regression(**settings: Any) -> LogisticRegression:
    """Any number of classes, no penalty, no intercept."""
    chosen = {"family": "multinomial", "regParam": 0.0, "fitIntercept": False, "aggregationDepth": 2}
    return LogisticRegression(**{**chosen, **settings})


def naive_bayes(smoothing: float = 1.0) -> NaiveBayes:
    return NaiveBayes(modelType="multinomial", smoothing=smoothing)


def perceptron(layers: Sequence[int], seed: int = 1234, **settings: Any) -> MultilayerPerceptronClassifier:
    """Labels must be 0..K-1 and the layers must end in K."""
    chosen = {"blockSize": 128, "maxIter": 5}
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed, **{**chosen, **settings})


def forest_pipeline(
    labels: Sequence[str], seed: int, trees: int = 20, max_categories: int = 20, **settings: Any
) -> Pipeline:
    """Index labels and categories, grow a forest, decode its prediction.

    ``labels`` is the label domain in index order.  The category indexer is an
    unfitted stage, so it learns from training rows only and its settings can
    be tuned.  ``prediction`` is an index; compare ``predictedLabel`` with the
    label, or ``prediction`` with ``indexedLabel``.
    """
    from pyspark.ml.feature import StringIndexerModel

    label_indexer = StringIndexerModel.from_labels(
        list(labels), inputCol="label", outputCol="indexedLabel", handleInvalid="error"
    )
    category_indexer = VectorIndexer(
        inputCol="features",
        outputCol="indexedFeatures",
        maxCategories=max_categories,
        handleInvalid="keep",
    )
    forest = RandomForestClassifier(
        labelCol="indexedLabel",
        featuresCol="indexedFeatures",
        numTrees=trees,
        seed=seed,
        maxBins=max(32, max_categories + 2),
        **settings,
    )
    decoder = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=list(labels))
    return Pipeline(stages=[label_indexer, category_indexer, forest, decoder])


def fit_label_index(df: DataFrame, label: str = "label", out: str = "indexedLabel"):
    """Number labels by descending frequency over the whole data set."""
    return StringIndexer(
        inputCol=label, outputCol=out, stringOrderType="frequencyDesc", handleInvalid="error"
    ).fit(df)


def decode_labels(df: DataFrame, labels: Sequence[str], index: str, out: str) -> DataFrame:
    return IndexToString(inputCol=index, outputCol=out, labels=list(labels)).transform(df)


def class_probability(position: int = 1, probability: str = "probability") -> Column:
    """Score of one class in place of the predicted class."""
    return vector_to_array(F.col(probability))[position]


def above_threshold(score: Column, threshold: float | Column) -> Column:
    """1.0 where the score is strictly above the threshold, else 0.0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(score > limit, 1.0).otherwise(0.0)


def linear_score(weights: Sequence[float], intercept: float, values: Sequence[Column]) -> Column:
    """P(class 1) of a stored two-class linear model, as one expression."""
    margin = F.lit(float(intercept))
    for w, v in zip(weights, values, strict=True):
        margin = margin + F.lit(float(w)) * v
    return 1.0 / (1.0 + F.exp(-margin))


def scored_rows(predictions: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``(keep..., label, prediction, probability[])``: every scored row."""
    return predictions.select(
        *keep, "label", "prediction", vector_to_array("probability").alias("probability")
    )


def coefficient_table(
    spark: SparkSession, model: Any, names: Sequence[str], pivot: bool = False
) -> DataFrame:
    """``(class, pos, name, weight)`` of a fitted regression.

    ``pivot`` subtracts the row of class 0, the form that gives K - 1 rows for
    K classes.
    """
    matrix = model.coefficientMatrix.toArray()
    first = 0
    if matrix.shape[0] == 1:
        first = 1  # two classes: the only row belongs to class 1
    elif pivot:
        matrix, first = matrix[1:] - matrix[0], 1
    rows = [
        (first + c, p, names[p], float(matrix[c, p]))
        for c in range(matrix.shape[0])
        for p in range(matrix.shape[1])
    ]
    return spark.createDataFrame(rows, "class int, pos int, name string, weight double")


def importance_table(spark: SparkSession, model: Any, names: Sequence[str]) -> DataFrame:
    """``(pos, name, importance)`` of a fitted forest."""
    values = model.featureImportances.toArray()
    rows = [(p, names[p], float(v)) for p, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos int, name string, importance double")


def forest_table(spark: SparkSession, model: Any) -> DataFrame:
    """``(tree, nodes, depth, rules)``: the learned trees as text."""
    rows = [(i, t.numNodes, t.depth, t.toDebugString) for i, t in enumerate(model.trees)]
    return spark.createDataFrame(rows, "tree int, nodes int, depth int, rules string")


def parameter_table(spark: SparkSession, model: PipelineModel | Model) -> DataFrame:
    """``(stage, param, value)`` of every stage of a fitted model."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    rows = [
        (i, p.name, str(v))
        for i, stage in enumerate(stages)
        for p, v in sorted(stage.extractParamMap().items(), key=lambda kv: kv[0].name)
    ]
    return spark.createDataFrame(rows, "stage int, param string, value string")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
