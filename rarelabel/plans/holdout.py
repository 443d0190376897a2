"""Naive Bayes over many rounds, folds or smoothing values in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import Features
from ..operators import naive_bayes as nb
from ..operators.counts import class_counts
from ..operators.split import holdout_plan, with_cell, with_fold

CELLS = 4096


def naive_bayes_rounds(
    df: DataFrame,
    features: Features,
    label: str,
    key: str | Sequence[str],
    rounds: int,
    seed: int,
    test: float = 0.2,
    cells: int = CELLS,
    smoothing: float = 1.0,
    probability_of: Any = None,
) -> DataFrame:
    """Held-out predictions of all rounds: ``(round, label, prediction[, probability])``.

    The training side of every round comes from one aggregation per cell; the
    scoring side expands each row to the rounds that hold it out and never
    shuffles it.
    """
    labels = list(class_counts(df, label))
    celled = with_cell(df, key, cells, seed)
    sums = nb.class_sums(celled, features, label, ["cell"])
    plan = holdout_plan(df.sparkSession, rounds, cells, test, seed)
    model = nb.fit_from_sums(
        nb.round_sums(sums, plan, features.width), features.width, ["round"], smoothing
    )
    rows = nb.held_out_rows(celled.withColumn("label", F.col(label)), plan)
    return nb.score(
        rows, model, features, labels, ["round"], rounds, ["round", "label"], probability_of
    )


def naive_bayes_folds(
    df: DataFrame,
    features: Features,
    label: str,
    key: str | Sequence[str],
    folds: int,
    seed: int,
    smoothing: Sequence[float] = (1.0,),
    probability_of: Any = None,
) -> DataFrame:
    """Cross-validated predictions: ``(smoothing, fold, label, prediction[, probability])``."""
    labels = list(class_counts(df, label))
    folded = with_fold(df, key, folds, seed)
    sums = nb.fold_sums(nb.class_sums(folded, features, label, ["fold"]), features.width, folds)
    tries = F.explode(F.array(*[F.lit(float(s)) for s in smoothing])).alias("smoothing")
    by = ["smoothing", "fold"]
    model = nb.fit_from_sums(
        sums.select(tries, "fold", "label", "n", "sums"), features.width, by, "smoothing"
    )
    rows = folded.withColumn("label", F.col(label)).select("*", tries)
    return nb.score(
        rows, model, features, labels, by, folds * len(smoothing), [*by, "label"], probability_of
    )
