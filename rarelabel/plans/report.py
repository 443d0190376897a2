"""All metrics of a prediction table in one long table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ensure_checkpoint_dir
from ..operators import confusion as cm
from ..operators.curves import areas_of_sorted, sorted_by_score

CLASS_METRICS = ("precision", "recall", "f1", "fpr")
OVERALL_METRICS = (
    "accuracy",
    "micro_precision",
    "micro_recall",
    "micro_f1",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "macro_fpr",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
    "weighted_fpr",
)
AREAS = ("roc_auc", "pr_auc")


def _long(wide: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per metric; a single pass, no matter how many metrics."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return wide.select(*ids, F.inline(F.array(*cells)))


def evaluation_report(
    predictions: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
    domain: DataFrame | None = None,
    score: str | None = None,
    positive: Any = None,
) -> DataFrame:
    """``(by..., label, metric, value)``; ``label`` is null for overall metrics.

    The prediction table is read once.  Rows are counted by label, prediction
    and, if ``score`` is given, score in its own type; those counts are stored once, in
    order of the score, and everything else comes from them.
    """
    if score is not None and positive is None:
        raise ValueError("areas need the positive class; use one-vs-rest areas for several classes")
    ensure_checkpoint_dir(predictions.sparkSession)
    scores = [F.col(score).alias("score")] if score is not None else []
    counted = predictions.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction"), *scores).agg(F.count(F.lit(1)).alias("n"))
    counted = sorted_by_score(counted, by) if score is not None else counted.checkpoint(eager=True)
    counts = counted.groupBy(*by, "label", "prediction").agg(F.sum("n").alias("n"))
    totals = cm.class_totals(counts, by, domain)
    kind = totals.schema["label"].dataType
    per_class = _long(cm.class_metrics(totals, by), [*by, "label"], CLASS_METRICS)
    nobody = F.lit(None).cast(kind).alias("label")
    overall = _long(cm.overall_metrics(totals, by).withColumn("label", nobody), [*by, "label"], OVERALL_METRICS)
    report = per_class.unionByName(overall)
    if score is not None:
        hit = F.col("label") == F.lit(positive)
        nothing = F.lit(0).cast("bigint")
        points = counted.select(*by, "score", "_part", F.when(hit, F.col("n")).otherwise(nothing).alias("p"), F.when(hit, nothing).otherwise(F.col("n")).alias("n"))
        areas = areas_of_sorted(points, by)
        report = report.unionByName(_long(areas.withColumn("label", nobody), [*by, "label"], AREAS))
    return report.select(*by, F.col("label").cast("string").alias("label"), "metric", "value")


def write_report(report: DataFrame, path: str, experiment: str) -> None:
    """Add a report under ``experiment=...``, replacing that experiment only."""
    (
        report.withColumn("experiment", F.lit(experiment))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("experiment")
        .parquet(path)
    )
