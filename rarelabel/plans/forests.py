"""Cross-validated forest sizes from one fit of the largest forest per fold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import confusion as cm
from ..operators import forest
from . import learners
from .learners import held_in_memory
from .tuning import run_side_by_side


def forest_sizes(df: DataFrame, labels: Sequence[str], key: str, sizes: Sequence[int], category_limits: Sequence[int], folds: int, seed: int, fold_col: str = "fold", metric: str = "weighted_f1", resample: Callable[[DataFrame], DataFrame] | None = None, parallelism: int = 4) -> DataFrame:
    """``(params, part, metric)`` for every size, category limit and fold.

    In each fold and for each limit the largest forest is grown once on the
    training side, resampled if ``resample`` is given; smaller ones are its first
    trees.  ``df`` has ``label`` (a string of ``labels``), ``features``, ``key`` and
    ``fold_col``.
    """
    spark, found = df.sparkSession, []
    with held_in_memory(df) as held:
        for fold in range(folds):
            train, test = held.filter(F.col(fold_col) != fold), held.filter(F.col(fold_col) == fold)
            with held_in_memory(resample(train)) if resample else nullcontext(train) as ready:

                def one(limit: int, train=ready, test=test, fold=fold) -> list[tuple[str, int, float]]:
                    model = learners.forest_pipeline(labels, seed, max(sizes), limit).fit(train)
                    indexed = PipelineModel(model.stages[:2]).transform(test)
                    nodes = forest.node_table(spark, model.stages[2])
                    judged = forest.votes(indexed.select(key, "indexedLabel", "indexedFeatures"), nodes, [key, "indexedLabel"], "indexedFeatures", sizes)
                    counts = cm.confusion(judged, ["size"], label="indexedLabel")
                    overall = cm.overall_metrics(cm.class_totals(counts, ["size"]), ["size"])
                    return [(f"maxCategories={limit}, numTrees={r['size']}", fold, float(r[metric])) for r in overall.select("size", metric).collect()]

                for rows in run_side_by_side([lambda n=n: one(n) for n in category_limits], parallelism):
                    found += rows
    return spark.createDataFrame(found, "params string, part int, metric double")
