"""Cross-validation and repeated hold-outs for any ``pyspark.ml`` estimator.

Fits are Spark jobs; a few run side by side from driver threads.  Results are
one row per (parameters, fold or round, metric).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextlib import nullcontext
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.split import cell_is_test
from .learners import held_in_memory

RESULT = "params string, part int, metric double"


def param_grid(choices: Mapping[Any, Sequence[Any]] | None = None) -> list[dict]:
    """All combinations; no choices give one candidate."""
    builder = ParamGridBuilder()
    for param, values in (choices or {}).items():
        builder = builder.addGrid(param, list(values))
    return builder.build()


def describe(params: Mapping[Any, Any]) -> str:
    return ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


def cross_validator(
    estimator: Estimator,
    evaluator: Evaluator,
    grid: Sequence[Mapping[Any, Any]],
    folds: int = 10,
    fold_col: str | None = None,
    seed: int = 0,
    parallelism: int = 4,
) -> CrossValidator:
    """The library's cross-validator, for estimators that need no resampling."""
    cv = CrossValidator(
        estimator=estimator,
        evaluator=evaluator,
        estimatorParamMaps=list(grid),
        numFolds=folds,
        seed=seed,
        parallelism=parallelism,
    )
    return cv.setFoldCol(fold_col) if fold_col else cv


def run_side_by_side(tasks: Sequence[Callable[[], Any]], parallelism: int) -> list[Any]:
    """Results of jobs started from a few driver threads, in order."""
    pool = ThreadPool(processes=max(1, min(parallelism, len(tasks))))
    try:
        return pool.map(inheritable_thread_target(lambda task: task()), tasks)
    finally:
        pool.close()


def cross_validate(
    df: DataFrame,
    estimator: Estimator,
    evaluator: Evaluator,
    grid: Sequence[Mapping[Any, Any]],
    folds: int,
    fold_col: str = "fold",
    resample: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """``(params, part, metric)`` for every candidate and fold.

    ``resample`` is applied to the training side of each fold only, so that no
    copy of a row is both trained on and tested.  ``fold_col`` holds 0..folds-1.
    """
    rows: list[tuple[str, int, float]] = []
    with held_in_memory(df) as held:
        for fold in range(folds):
            train = held.filter(F.col(fold_col) != fold)
            test = held.filter(F.col(fold_col) == fold)
            # without resampling the training side is only a filter on the held table
            with held_in_memory(resample(train)) if resample else nullcontext(train) as ready:

                def one(params: Mapping[Any, Any], train=ready, test=test) -> float:
                    return float(evaluator.evaluate(estimator.fit(train, dict(params)).transform(test)))

                found = run_side_by_side([lambda p=p: one(p) for p in grid], parallelism)
            rows += [(describe(p), fold, m) for p, m in zip(grid, found)]
    return df.sparkSession.createDataFrame(rows, RESULT)


def repeated_holdout(
    df: DataFrame,
    estimator: Estimator,
    evaluators: Mapping[str, Evaluator],
    rounds: int,
    seed: int,
    test: float = 0.2,
    cell_col: str = "cell",
    resample: Callable[[DataFrame], DataFrame] | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """``(round, metric, value)``: fit and test on a new split in every round."""

    def one(round_id: int, held: DataFrame) -> list[tuple[int, str, float]]:
        is_test = cell_is_test(cell_col, F.lit(round_id), test, seed)
        train = held.filter(~is_test)
        with held_in_memory(resample(train)) if resample else nullcontext(train) as ready:
            model = estimator.fit(ready)
        with held_in_memory(model.transform(held.filter(is_test))) as scored:
            return [(round_id, name, float(e.evaluate(scored))) for name, e in evaluators.items()]

    with held_in_memory(df) as held:
        parts = run_side_by_side([lambda r=r: one(r, held) for r in range(rounds)], parallelism)
    return df.sparkSession.createDataFrame(
        [row for part in parts for row in part], "round int, metric string, value double"
    )


def summarize(results: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, spread and quartiles over rounds or folds."""
    return results.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stddev"),
        F.percentile(value, 0.25).alias("q25"),
        F.percentile(value, 0.5).alias("median"),
        F.percentile(value, 0.75).alias("q75"),
    )


def ranked_candidates(results: DataFrame, params: str = "params", metric: str = "metric", larger_is_better: bool = True) -> DataFrame:
    """``(params, folds, avg_metric, rank)`` of all candidates, from 1; ties as in ``best_params``.

    A candidate without any metric comes last.  There is one row per candidate.
    """
    means = results.groupBy(F.col(params).alias("params")).agg(F.count(metric).alias("folds"), F.avg(metric).alias("avg_metric"))
    rounded = F.round("avg_metric", 12)
    order = rounded.desc_nulls_last() if larger_is_better else rounded.asc_nulls_last()
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "params")))


def refit_best(df: DataFrame, estimator: Estimator, grid: Sequence[Mapping[Any, Any]], results: DataFrame) -> tuple[Any, DataFrame]:
    """The winning candidate fitted on all rows of ``df``, and the ranks it won by."""
    ranked = ranked_candidates(results).checkpoint()
    winner = ranked.where("rank = 1").first()["params"]
    return estimator.fit(df, dict(next(g for g in grid if describe(g) == winner))), ranked


def best_params(
    results: DataFrame, params: str = "params", metric: str = "metric", larger_is_better: bool = True
) -> DataFrame:
    """``(params, avg_metric)`` of the best candidate; ties go to the first in text order.

    Averages that agree to twelve digits are ties: the last bits of a sum depend
    on the order in which tasks finish.
    """
    means = results.groupBy(params).agg(F.avg(metric).alias("avg_metric"))
    rounded = F.round("avg_metric", 12)
    order = rounded.desc() if larger_is_better else rounded.asc()
    return means.orderBy(order, F.col(params)).limit(1)
