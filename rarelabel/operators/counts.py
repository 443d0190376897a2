"""Class counts: histograms, extremes and label domains."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 10_000


def class_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n)``; counts are combined in each task before the shuffle."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_extremes(df: DataFrame, label: str = "label") -> DataFrame:
    """Largest and smallest class, number of classes and of rows."""
    return class_histogram(df, label).agg(
        F.max("n").alias("max_n"),
        F.min("n").alias("min_n"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("n").alias("rows"),
    )


def label_domain(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels, made distinct before anything reaches the driver."""
    return df.select(label).distinct()


def collect_bounded(df: DataFrame, limit: int, what: str) -> list[Any]:
    """Bring a table to the driver only if it has at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} {what}; this step keeps one entry for each in memory")
    return rows


def class_counts(df: DataFrame, label: str = "label", limit: int = MAX_CLASSES) -> dict[Any, int]:
    """Class sizes by ascending label: a checked, small map for planning."""
    rows = collect_bounded(class_histogram(df, label), limit, "classes")
    counts = {r[label]: r["n"] for r in rows}
    if None in counts:
        raise ValueError(f"column {label} has {counts[None]} null labels; drop or fill them first")
    return dict(sorted(counts.items()))
