"""Chi-square test of every feature against the label, and selection by it.

Every distinct value of a feature is a category, so the statistic of columns
with very many values grows with their number of values.  ``value_share`` in the report
shows such columns, and ``warn_of_identifiers`` names them; leave row ids out with ``exclude``.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.probability import chi_square_p_value
from ..functions.ranking import ensure_checkpoint_dir
from .counts import class_histogram

BROADCAST_CLASSES = 100_000
IDENTIFIER_SHARE = 0.5


def chi_square_scores(df: DataFrame, features: Features, label: str = "label") -> DataFrame:
    """``(pos, name, statistic, degrees, value_share)``, one row per feature.

    Tasks count by (position, value, class) before they send, so a value shared by
    most rows travels once per task and class.  The statistic is the sum of
    (observed - expected)^2 / expected over cells that hold rows, plus the rows
    expected in all empty cells, whose total is known from the classes that a value
    lacks.  That is exact for any number of classes; class sizes are sent to the
    counts up to ``BROADCAST_CLASSES`` classes and joined by shuffle beyond.  A null
    label is an error.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sizes = class_histogram(df, label).select(F.col(label).alias("_c"), F.col("n").alias("_size")).checkpoint()
    rows, classes, unlabelled = sizes.agg(F.sum("_size"), F.count(F.lit(1)), F.sum(F.when(F.col("_c").isNull(), F.col("_size")))).first()
    if unlabelled:
        raise ValueError(f"column {label} has {unlabelled} null labels; drop or fill them first")
    rows = float(rows or 0)
    shares = sizes.select("_c", (F.col("_size") / F.lit(rows)).alias("_share"))
    shares = F.broadcast(shares) if classes <= BROADCAST_CLASSES else shares
    counted = features.long(df, [F.col(label).alias("_label")]).groupBy("pos", "value", "_label").agg(F.count(F.lit(1)).alias("_o"))
    cells = counted.join(shares, F.col("_label") == F.col("_c"))
    # the cells of one value: as many as there are classes at most
    held = cells.groupBy("pos", "value").agg(F.sum("_o").alias("_r"), F.sum("_share").alias("_held"), F.collect_list(F.struct("_o", "_share")).alias("_cells"))
    off = lambda c: c["_o"] - F.col("_r") * c["_share"]
    term = F.aggregate("_cells", F.lit(0.0), lambda t, c: t + off(c) * off(c) / (F.col("_r") * c["_share"]))
    empty = F.col("_r") * F.greatest(F.lit(0.0), 1.0 - F.col("_held"))
    names = F.array(*[F.lit(n) for n in features.names])
    return (
        held.select("pos", (term + empty).alias("_term"))
        .groupBy("pos")
        .agg(F.sum("_term").alias("statistic"), F.count(F.lit(1)).alias("_values"))
        .select(
            "pos",
            names[F.col("pos")].alias("name"),
            "statistic",
            ((F.col("_values") - 1) * (classes - 1)).alias("degrees"),
            (F.col("_values") / rows).alias("value_share"),
        )
    )


def warn_of_identifiers(scores: DataFrame, share: float = IDENTIFIER_SHARE) -> list[str]:
    """Names of features with almost as many values as rows, with a warning: they win by their number of values alone."""
    named = [r["name"] for r in scores.where(F.col("value_share") >= share).orderBy("pos").select("name").collect()]
    if named:
        warnings.warn(f"features with a value for every {1 / share:g} rows or fewer: {', '.join(named)}; leave out identifiers", stacklevel=2)
    return named


def with_p_value(scores: DataFrame) -> DataFrame:
    return scores.withColumn("p_value", chi_square_p_value("statistic", "degrees"))


def rank_features(scores: DataFrame, rank_by: str = "statistic") -> DataFrame:
    """Add ``rank`` 1, 2, ...; ties go to the lower position."""
    if rank_by == "statistic":
        order = [F.col("statistic").desc(), F.col("pos")]
    elif rank_by == "p_value":
        scores = scores if "p_value" in scores.columns else with_p_value(scores)
        order = [F.col("p_value"), F.col("pos")]
    else:
        raise ValueError("rank_by must be 'statistic' or 'p_value'")
    # one row per feature
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def top_features(ranked: DataFrame, k: int) -> DataFrame:
    """The k best features, in rank order."""
    return ranked.filter(F.col("rank") <= k)


def selected_positions(ranked: DataFrame, k: int) -> list[int]:
    """Positions of the k best features, ascending: k small integers."""
    return sorted(r["pos"] for r in top_features(ranked, k).select("pos").collect())


def project(df: DataFrame, features: Features, positions: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """Keep only the selected positions, under the old names."""
    if features.vector is None:
        return df.select(*keep, *[F.col(f"`{features.names[p]}`") for p in positions])
    cut = VectorSlicer(inputCol=features.vector, outputCol="_cut", indices=list(positions))
    return cut.transform(df).select(*keep, F.col("_cut").alias(features.vector))


def sweep_sizes(width: int, parts: int = 8) -> list[int]:
    """Selection sizes 1/8, 2/8, ... 7/8 of the width, rounded, without repeats."""
    return sorted({max(1, (2 * width * i + parts) // (2 * parts)) for i in range(1, parts)})


def sweep(ranked: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``(k, rank, pos)`` for every size, from one ranking."""
    return ranked.select(
        F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k"), "rank", "pos"
    ).filter(F.col("rank") <= F.col("k"))
