"""Exact areas under the ROC and precision-recall curves, by two-level prefix sums.

Rows are first reduced to one row per group and score.  That table is sorted by
range in parallel and stored once, so rows of a group lie in order over a few
partitions, and rows behind it are never computed twice.  Running counts are made
inside each partition and shifted by the totals of the group's earlier partitions,
of which there is one row each.  Equal scores share a partition, and the areas are
exact wherever the cuts lie.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.ranking import ensure_checkpoint_dir

_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def score_counts(
    scored: DataFrame,
    score: str,
    positive: Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., score, p, n)``: positive and negative rows at each score."""
    return (
        scored.groupBy(*by, F.col(score).alias("score"))
        .agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    )


def one_vs_rest_counts(scored: DataFrame, score: str, label: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, score, p, n)`` with each class in turn as the positive one.

    All classes are judged on the same score column.
    """
    per_score = (
        scored.groupBy(*by, F.col(score).alias("score"))
        .agg(
            F.count(F.lit(1)).alias("_all"),
            *[F.count_if(F.col(label) == F.lit(c)).alias(f"_p{i}") for i, c in enumerate(classes)],
        )
    )
    return per_score.select(
        *by,
        "score",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("label"),
                        F.col(f"_p{i}").alias("p"),
                        (F.col("_all") - F.col(f"_p{i}")).alias("n"),
                    )
                    for i, c in enumerate(classes)
                ]
            )
        ),
    ).select(*by, "label", "score", "p", "n")


def _unscored(counts: DataFrame) -> Column:
    missing = F.col("score").isNull()
    if isinstance(counts.schema["score"].dataType, (DoubleType, FloatType)):
        missing = missing | F.isnan("score")
    return missing


def sorted_by_score(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``counts`` in order of group and falling score, stored, with ``_part``, the number of a row's partition."""
    ensure_checkpoint_dir(counts.sparkSession)
    placed = counts.orderBy(*[F.col(c) for c in by], F.col("score").desc()).checkpoint(eager=True)
    return placed.withColumn("_part", F.shiftright(F.monotonically_increasing_id(), _PARTITION_BITS))


def curve_areas(counts: DataFrame, by: Sequence[str] = (), unscored: str = "warn") -> DataFrame:
    """``(by..., positives, negatives, roc_auc, pr_auc)``, exact.

    An area is null if its curve does not exist.  Scores are compared in their
    own type.  Rows whose score is null or NaN count for neither side; a warning
    tells their number, or an error if ``unscored`` is "error".
    """
    return areas_of_sorted(sorted_by_score(counts, by), by, unscored)


def areas_of_sorted(stored: DataFrame, by: Sequence[str] = (), unscored: str = "warn") -> DataFrame:
    """``curve_areas`` of what ``sorted_by_score`` gave; several rows may have one score."""
    by = list(by)
    missing = stored.filter(_unscored(stored)).agg(F.sum(F.col("p") + F.col("n"))).first()[0]
    if missing:
        message = f"{missing} rows have no score"
        if unscored == "error":
            raise ValueError(message)
        warnings.warn(f"{message} and are left out", stacklevel=3)
        stored = stored.filter(~_unscored(stored))
    keys = [*by, "_part"]
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the table and each group in it
    totals = (
        stored.groupBy(*keys)
        .agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
        .select(
            *keys,
            F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_tp0"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_fp0"),
            F.sum("_p").over(whole).alias("positives"),
            F.sum("_n").over(whole).alias("negatives"),
        )
    )
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc())
    running = down.rowsBetween(Window.unboundedPreceding, 0)
    # dealt by group and partition once, for the sums by score and the running sums
    at_score = stored.repartition(*keys).groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    points = (
        at_score.withColumn("_tp", F.sum("p").over(running))
        .withColumn("_fp", F.sum("n").over(running))
        .join(totals, keys)
        .withColumn("_tp", (F.col("_tp") + F.col("_tp0")).cast("double"))
        .withColumn("_fp", (F.col("_fp") + F.col("_fp0")).cast("double"))
    )
    tp, fp, p, n = F.col("_tp"), F.col("_fp"), F.col("p"), F.col("n")
    tp_before, fp_before = tp - p, fp - n
    here = tp / (tp + fp)
    before = F.when(tp_before + fp_before > 0, tp_before / (tp_before + fp_before)).otherwise(here)
    areas = points.groupBy(*by).agg(
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
        F.sum(n * (tp_before + tp) / 2).alias("_roc"),
        F.sum(p * (before + here) / 2).alias("_pr"),
    )
    pos, neg = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return areas.select(
        *by,
        "positives",
        "negatives",
        F.when((pos > 0) & (neg > 0), F.col("_roc") / (pos * neg)).alias("roc_auc"),
        F.when(pos > 0, F.col("_pr") / pos).alias("pr_auc"),
    )


def binary_areas(
    scored: DataFrame,
    score: str,
    label: str = "label",
    positive: object = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Areas for one positive class against all other rows."""
    counts = score_counts(scored, score, F.col(label) == F.lit(positive), by)
    return curve_areas(counts, by)


def one_vs_rest_areas(scored: DataFrame, score: str, label: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Areas with each class in turn as the positive one, for each group of ``by``."""
    return curve_areas(one_vs_rest_counts(scored, score, label, classes, by), [*by, "label"])


def class_score_areas(scored: DataFrame, scores: str, label: str, classes: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Areas per class when every class has its own score, for each group of ``by``.

    ``scores`` is an array column in the order of ``classes``, such as the class
    probabilities of a classifier.
    """
    sides = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"),
                F.col(scores)[i].alias("score"),
                (F.col(label) == F.lit(c)).alias("hit"),
            )
            for i, c in enumerate(classes)
        ]
    )
    long = scored.select(*by, F.inline(sides))
    counts = score_counts(long, "score", F.col("hit"), [*by, "label"])
    return curve_areas(counts, [*by, "label"])


def macro_areas(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain average over the classes that have an area."""
    return areas.groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc"))
