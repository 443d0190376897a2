"""Rounds, folds and penalties of two-class regressions, all fitted together.

Every plan is a table of models and two tables of cells by models: what a model
is trained on and what it is judged on.  ``operators.regression`` fits all models
in one job per Newton step, and one more pass scores all held-out rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.hashing import uniform_hash
from ..operators import regression
from ..operators.curves import binary_areas
from ..operators.split import cell_is_test, with_cell, with_fold
from .learners import held_in_memory

CELLS = 256
DIGITS = 9  # of a score where rows are ranked: sums in another order differ beyond that


@dataclass
class Design:
    """Models in order: their round, fold (None: no fold) and penalty, and their cells."""

    cells: int
    models: list[tuple[int, int | None, float]] = field(default_factory=list)
    trained: list[np.ndarray] = field(default_factory=list)
    judged: list[np.ndarray] = field(default_factory=list)

    def add(self, round_id: int, fold: int | None, penalty: float, trained: np.ndarray, judged: np.ndarray) -> None:
        self.models.append((round_id, fold, float(penalty)))
        self.trained.append(trained)
        self.judged.append(judged)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(m, r, f, p) for m, (r, f, p) in enumerate(self.models)]
        return spark.createDataFrame(rows, "model int, round int, fold int, penalty double")


def drawn_cells(spark: SparkSession, rounds: int, cells: int, test: float, seed: int, folds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(held out, fold) of each cell in each round; its size does not depend on the rows."""
    every = spark.range(cells).select(F.col("id").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    fold = (uniform_hash("cell", "round", seed=seed + 1) % folds).cast("int")
    held, dealt = np.zeros((cells, rounds), bool), np.zeros((cells, rounds), np.int64)
    for r in every.select("cell", "round", cell_is_test("cell", "round", test, seed).alias("held"), fold.alias("fold")).collect():
        held[r["cell"], r["round"]], dealt[r["cell"], r["round"]] = r["held"], r["fold"]
    return held, dealt


def fit_design(rows: DataFrame, width: int, design: Design) -> regression.Fits:
    return regression.fit_many(rows, width, np.column_stack(design.trained), [p for _, _, p in design.models])


def areas_of(rows: DataFrame, width: int, design: Design, fits: regression.Fits) -> DataFrame:
    """``(model, round, fold, penalty, positives, negatives, roc_auc, pr_auc)`` on each model's held-out rows."""
    scored = regression.score_many(rows, width, fits.weights, np.column_stack(design.judged)).withColumn("score", F.round("score", DIGITS))
    return F.broadcast(design.table(rows.sparkSession)).join(binary_areas(scored, "score", "y", 1.0, ["model"]), "model")


def regression_rounds(df: DataFrame, features: Features, label: str, key: str | Sequence[str], rounds: int, seed: int, penalty: float = 1.0, test: float = 0.2, cells: int = CELLS) -> DataFrame:
    """Repeated hold-out: ``(round, roc_auc, pr_auc)`` of every round."""
    held, _ = drawn_cells(df.sparkSession, rounds, cells, test, seed)
    design = Design(cells)
    for r in range(rounds):
        design.add(r, None, penalty, ~held[:, r], held[:, r])
    celled = regression.labelled_cells(with_cell(df, key, cells, seed, "_cell"), features, label, "_cell")
    with held_in_memory(celled) as ready:
        return areas_of(ready, features.width, design, fit_design(ready, features.width, design)).select("round", "roc_auc", "pr_auc").checkpoint()


def regression_folds(df: DataFrame, features: Features, label: str, key: str | Sequence[str], folds: int, seed: int, penalties: Sequence[float] = (1.0,)) -> tuple[DataFrame, regression.Fits]:
    """Cross-validation: ``(penalty, fold, roc_auc, pr_auc)``, and one fit per penalty on all rows."""
    design = Design(folds)
    each = np.arange(folds)
    for p in penalties:
        for f in range(folds):
            design.add(0, f, p, each != f, each == f)
    for p in penalties:
        design.add(0, None, p, each >= 0, each < 0)
    folded = regression.labelled_cells(with_fold(df, key, folds, seed, "_fold"), features, label, "_fold")
    with held_in_memory(folded) as ready:
        fits = fit_design(ready, features.width, design)
        areas = areas_of(ready, features.width, design, fits).select("penalty", "fold", "roc_auc", "pr_auc").checkpoint()
    last = slice(folds * len(penalties), None)
    return areas, regression.Fits(fits.weights[last], fits.slope[last], fits.settled[last], fits.steps)


def regression_nested(df: DataFrame, features: Features, label: str, key: str | Sequence[str], rounds: int, folds: int, seed: int, penalties: Sequence[float], test: float = 0.2, cells: int = CELLS) -> DataFrame:
    """Cross-validation inside every hold-out: ``(round, penalty, cv_roc_auc, roc_auc, pr_auc)``.

    In each round the penalty with the largest mean area over the folds of its
    training rows wins, the smaller one if means agree to twelve digits.
    """
    held, dealt = drawn_cells(df.sparkSession, rounds, cells, test, seed, folds)
    design = Design(cells)
    for r in range(rounds):
        for p in penalties:
            design.add(r, None, p, ~held[:, r], held[:, r])
            for f in range(folds):
                design.add(r, f, p, ~held[:, r] & (dealt[:, r] != f), ~held[:, r] & (dealt[:, r] == f))
    celled = regression.labelled_cells(with_cell(df, key, cells, seed, "_cell"), features, label, "_cell")
    with held_in_memory(celled) as ready:
        areas = areas_of(ready, features.width, design, fit_design(ready, features.width, design)).checkpoint()
    inner = areas.where("fold is not null").groupBy("round", "penalty").agg(F.avg("roc_auc").alias("cv_roc_auc"))
    # a few candidates in each window
    first = Window.partitionBy("round").orderBy(F.round("cv_roc_auc", 12).desc_nulls_last(), "penalty")
    best = inner.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return best.join(areas.where("fold is null").select("round", "penalty", "roc_auc", "pr_auc"), ["round", "penalty"])
