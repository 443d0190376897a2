"""Many two-class logistic regressions at once, by Newton's method.

All models of a tuning run, one for each round, fold and penalty, are fitted
together: a step reads the table once, and each task adds up slopes and curvature
for every model from matrix products.  A model is trained on a set of cells (see
``operators.split``), so rows are never copied for a round or a fold.  Tasks send
one row of sums per model; the driver holds weights and solves one small system
per model, whatever the number of rows.

The loss is that of ``pyspark.ml``: the mean logistic loss plus
``penalty / 2 * sum((s_j w_j)^2)`` with s_j the sample deviation of feature j over
the model's training rows, the intercept free.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import Features

STEPS, TOLERANCE = 60, 1e-12
_CHUNK = 4_096


@dataclass(frozen=True)
class Fits:
    """Weights of all models, intercept first, and how far each is from its optimum.

    ``slope`` is the largest component of the gradient of the penalised loss, in
    units of standardised features; ``settled`` says that it is near zero and that a
    further step would not move the weights.
    """

    weights: np.ndarray
    slope: np.ndarray
    settled: np.ndarray
    steps: int

    def table(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """``(model, pos, name, weight)``; the intercept has position -1."""
        rows = [(m, p - 1, "intercept" if not p else names[p - 1], float(w)) for m, row in enumerate(self.weights) for p, w in enumerate(row)]
        return spark.createDataFrame(rows, "model int, pos int, name string, weight double")


def labelled_cells(df: DataFrame, features: Features, label: str, cell: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., cell, y, x)`` of rows; a null or unknown label, or a null value, is an error."""
    opened, values = features.open(df)
    y = F.col(label).cast("double")
    bad = F.raise_error(F.lit("a label is neither 0 nor 1")).cast("double")
    x = F.array(*[F.coalesce(v, F.raise_error(F.lit("a feature is null")).cast("double")) for v in values])
    return opened.select(*keep, F.col(cell).cast("int").alias("cell"), F.when(y.isin(0.0, 1.0), y).otherwise(bad).alias("y"), x.alias("x"))


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    cells, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for at in range(0, len(labels), _CHUNK):
        yield cells[at : at + _CHUNK], labels[at : at + _CHUNK], x[at : at + _CHUNK]


def _added(rows: DataFrame, width: int, models: int, size: int, add) -> np.ndarray:
    """Sums over all rows, models by size; ``add(out, cells, y, x)`` adds a chunk to ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((models, size))
        for batch in batches:
            for chunk in _read(batch, width):
                add(out, *chunk)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models), pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["model", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        sums = np.add.reduce(table["sums"].combine_chunks().flatten().to_numpy().reshape(-1, size))
        return pa.table({"model": table["model"].slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "model int, sums array<double>"
    merged = rows.select("cell", "y", "x").mapInArrow(run, kind).groupBy("model").applyInArrow(merge, kind)
    found = np.zeros((models, size))
    for r in merged.collect():  # one row per model
        found[r["model"]] = r["sums"]
    return found


def fit_many(rows: DataFrame, width: int, trained_on: np.ndarray, penalty: Sequence[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> Fits:
    """One model for each column of ``trained_on``, a table of cells by models.

    ``rows`` is what ``labelled_cells`` gives; it is read once per step, so keep it
    in memory.  Features that do not vary get weight 0 where there is a penalty.
    Training rows of one class only give an infinite intercept and no weights; a
    model without rows gets nulls (NaN).  Without a penalty, classes that can be
    separated have no optimum: the model stops unsettled after ``steps``.
    """
    used = trained_on.astype(np.float64)
    models = used.shape[1]
    penalty = np.asarray(penalty, np.float64)
    if len(penalty) != models:
        raise ValueError(f"{models} models and {len(penalty)} penalties")
    # a common centre and scale keep sums exact enough; any will do
    around = rows.agg(*[F.avg(F.col("x")[j]) for j in range(width)], *[F.stddev_pop(F.col("x")[j]) for j in range(width)]).first()
    centre, spread = (np.array([v or 0.0 for v in around[a:b]], np.float64) for a, b in ((0, width), (width, 2 * width)))
    spread[~(spread > 0)] = 1.0
    p = width + 1
    upper = np.triu_indices(p)

    def shaped(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), (x - centre) / spread])

    def count(out: np.ndarray, cells: np.ndarray, y: np.ndarray, x: np.ndarray) -> None:
        member, z = used[cells], shaped(x)
        out += member.T @ np.column_stack([z, z[:, 1:] ** 2, y])

    moments = _added(rows, width, models, 2 * p, count)
    n, ones = moments[:, 0], moments[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = np.maximum(0.0, (moments[:, p : 2 * p - 1] - moments[:, 1:p] ** 2 / n[:, None]) / (n[:, None] - 1))
    hold = np.column_stack([np.zeros(models), penalty[:, None] * np.nan_to_num(variance)])
    varies = np.column_stack([np.ones(models, bool), (variance > 1e-18) | (penalty[:, None] == 0)])
    open_ = (ones > 0) & (ones < n)
    weights = np.zeros((models, p))
    weights[open_, 0] = np.log(ones[open_] / (n[open_] - ones[open_]))

    def evaluated(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, slope and curvature of each model at its weights."""

        def add(out: np.ndarray, cells: np.ndarray, y: np.ndarray, x: np.ndarray) -> None:
            member, z = used[cells], shaped(x)
            margin = z @ at.T
            probability = 0.5 * (1.0 + np.tanh(0.5 * margin))
            loss = np.logaddexp(0.0, np.where(y[:, None] > 0.5, -margin, margin))
            out[:, 0] += (member * loss).sum(axis=0)
            out[:, 1 : 1 + p] += (member * (probability - y[:, None])).T @ z
            out[:, 1 + p :] += (member * probability * (1.0 - probability)).T @ (z[:, upper[0]] * z[:, upper[1]])

        sums = _added(rows, width, models, 1 + p + len(upper[0]), add) / np.maximum(n, 1.0)[:, None]
        bend = np.zeros((models, p, p))
        bend[:, upper[0], upper[1]] = sums[:, 1 + p :]
        bend[:, upper[1], upper[0]] = sums[:, 1 + p :]
        bend[:, np.arange(p), np.arange(p)] += hold
        return sums[:, 0] + 0.5 * (hold * at**2).sum(axis=1), np.where(varies, sums[:, 1 : 1 + p] + hold * at, 0.0), bend

    best, loss = weights.copy(), np.full(models, np.inf)
    slopes = np.zeros((models, p))
    moved = np.zeros((models, p))
    done = 0
    for done in range(1, steps + 1):
        now, slope, bend = evaluated(weights)
        worse = open_ & (now > loss + 1e-12 * np.abs(loss))
        better = open_ & ~worse
        best[better], loss[better], slopes[better] = weights[better], now[better], slope[better]
        # a step that went up is halved, others go on from where they are
        moved[worse] *= 0.5
        for m in np.flatnonzero(better):
            free = varies[m]
            moved[m] = 0.0
            moved[m, free] = -np.linalg.lstsq(bend[m][np.ix_(free, free)], slope[m, free], rcond=1e-14)[0]
        weights = best + moved
        if not (open_ & (np.abs(slopes).max(axis=1) > tolerance) & (np.abs(moved).max(axis=1) > 1e-13)).any():
            break
    plain = np.column_stack([best[:, 0] - (best[:, 1:] * centre / spread).sum(axis=1), best[:, 1:] / spread])
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = np.where(n > 0, np.where(ones > 0, np.inf, -np.inf), np.nan)
    plain[~open_] = 0.0
    plain[~open_, 0] = flat[~open_]
    size = np.abs(slopes).max(axis=1)
    # classes that can be separated have ever smaller slopes but steps that do not shrink
    still = np.abs(moved).max(axis=1) <= 1e-6 * (1.0 + np.abs(best).max(axis=1))
    return Fits(plain, size, ~open_ | ((size <= 1e3 * tolerance) & still), done)


def score_many(rows: DataFrame, width: int, weights: np.ndarray, scored_on: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., model, y, score)``: P(class 1) of each row under each model that scores its cell.

    ``scored_on`` is a table of cells by models.  No row is shuffled.
    """
    pairs = [np.flatnonzero(c) for c in scored_on]
    kept = rows.select(*keep).schema
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "model int, y double, score double"])
    first = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, y = (batch.column(first + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x = batch.column(first + 2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            each = np.repeat(np.arange(len(y)), [len(pairs[c]) for c in cells])
            model = np.concatenate([np.zeros(0, np.int64), *(pairs[c] for c in cells)])
            for at in range(0, len(each), 1 << 16):
                i, m = each[at : at + (1 << 16)], model[at : at + (1 << 16)]
                # one row and one model at a time, so that equal rows get equal scores
                margin = weights[m, 0] + (weights[m, 1:] * x[i]).sum(axis=1)
                columns = [c.take(pa.array(i)) for c in batch.columns[:first]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(m, pa.int32()), pa.array(y[i]), pa.array(0.5 * (1.0 + np.tanh(0.5 * margin)))], names=[*kept.names, "model", "y", "score"])

    return rows.select(*keep, "cell", "y", "x").mapInArrow(run, kind)
