"""Confusion counts and every metric that follows from them.

The rows are read once, by ``confusion``.  All other functions work on its
result: one row per (group, label, prediction), whatever the size of the table.
``by`` names group columns such as round, fold or parameter set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import MAX_CLASSES, collect_bounded


def confusion(
    predictions: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
) -> DataFrame:
    """``(by..., label, prediction, n)``."""
    return predictions.groupBy(
        *by, F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: Column, bottom: Column, empty: float | None) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def class_totals(
    counts: DataFrame, by: Sequence[str] = (), domain: DataFrame | None = None, groups: DataFrame | None = None
) -> DataFrame:
    """``(by..., label, tp, fp, fn, tn)`` for every class.

    ``domain`` holds the labels of the whole data set in its first column, so
    that classes missing from the predictions are listed too.  ``groups`` holds
    all groups in its columns ``by``; with a domain, those without predictions are
    listed too, with all classes at zero.  ``counts`` is used once: nothing here
    computes the predictions a second time.
    """
    kind = counts.schema["label"].dataType
    hit = F.col("label") == F.col("prediction")
    zero = F.lit(0).cast("bigint")

    def part(label: Column, tp: Column, fp: Column, fn: Column, seen: Column) -> Column:
        return F.struct(
            label.cast(kind).alias("c"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), seen.alias("seen")
        )

    n = F.col("n")
    # each confusion cell adds to its true class and, if wrong, to another one
    parts = F.array(
        part(F.col("label"), F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n), n),
        part(F.col("prediction"), zero, F.when(hit, zero).otherwise(n), zero, zero),
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    split = counts.select(*by, F.inline(parts))
    if domain is not None and not by:
        nothing = [zero.alias(m) for m in ("tp", "fp", "fn", "seen")]
        # the domain's own rows, so that all classes are there even without predictions
        split = split.unionByName(domain.select(F.col(domain.columns[0]).cast(kind).alias("c"), *nothing))
    elif domain is not None:
        labels = [r[0] for r in collect_bounded(domain, MAX_CLASSES, "classes")]
        absent = F.array(*[part(F.lit(c), zero, zero, zero, zero) for c in labels])
    if domain is not None and by and groups is not None:
        split = split.unionByName(groups.select(*by).distinct().select(*by, F.inline(absent)))
    elif domain is not None and by:
        first = F.row_number().over(group.orderBy("label", "prediction")) == 1
        counts = counts.withColumn("_first", first)
        split = counts.select(*by, F.inline(F.when(F.col("_first"), F.concat(parts, absent)).otherwise(parts)))
    return (
        split.groupBy(*by, "c")
        .agg(*[F.sum(m).alias(m) for m in ("tp", "fp", "fn", "seen")])
        .withColumn("_rows", F.sum("seen").over(group))
        .select(
            *by,
            F.col("c").alias("label"),
            "tp",
            "fp",
            "fn",
            (F.col("_rows") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"),
        )
    )


def class_metrics(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, precision, recall, f1, fpr, support)``.

    Precision and F1 are 0 if nothing was predicted; recall is null if the class has
    no rows, the false-positive rate if no other class has any.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return totals.select(
        *by,
        "label",
        _ratio(tp, tp + fp, 0.0).alias("precision"),
        _ratio(tp, tp + fn, None).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        _ratio(fp, fp + tn, None).alias("fpr"),
        (tp + fn).alias("support"),
    )


def overall_metrics(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy with micro, macro and weighted averages: one row per group.

    Micro precision, recall and F1 all equal accuracy when each row has exactly
    one label and one prediction; they are listed for completeness.
    """
    metrics = class_metrics(totals, by)
    support = F.col("support")
    names = ("precision", "recall", "f1", "fpr")
    averages = metrics.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        F.sum(F.coalesce(F.col("recall"), F.lit(0.0)) * support).alias("_hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[
            F.sum(F.coalesce(F.col(m), F.lit(0.0)) * support).alias(f"_weighted_{m}")
            for m in names
        ],
    )
    accuracy = F.col("_hits") / F.col("rows")
    return averages.select(
        *by,
        "rows",
        accuracy.alias("accuracy"),
        *[accuracy.alias(f"micro_{m}") for m in names[:3]],
        *[F.col(f"macro_{m}") for m in names],
        *[(F.col(f"_weighted_{m}") / F.col("rows")).alias(f"weighted_{m}") for m in names],
    )
