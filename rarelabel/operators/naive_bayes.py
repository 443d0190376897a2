"""Multinomial naive Bayes as grouped sums.

Fitting is one aggregation, so any number of rounds, folds and smoothing values
are fitted together: keep sums per cell of rows once, then add up the cells of
each round's training side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import Features
MODEL_BYTES = 256 << 20
MAX_TERMS = 2_000


def class_sums(
    df: DataFrame, features: Features, label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """``(by..., label, n, sums)``: rows and feature sums per class.

    One aggregation with a map-side combine.  A negative value is an error,
    because the model reads features as counts.
    """
    opened, values = features.open(df)
    # checked on the smallest value per group, not row by row
    grouped = opened.groupBy(*by, F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.least(*values) if len(values) > 1 else values[0]).alias("_low"),
        *[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)],
    )
    negative = F.raise_error(F.lit("naive Bayes needs features that are not negative")).cast("bigint")
    return grouped.select(
        *by,
        "label",
        F.when(F.col("_low") < 0, negative).otherwise(F.col("n")).alias("n"),
        F.array(*[F.col(f"_s{i}") for i in range(len(values))]).alias("sums"),
    )


def add_sums(sums: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """Add up ``(n, sums)`` over ``(by..., label)``."""
    return (
        sums.groupBy(*by, "label")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"_s{i}") for i in range(width)])
        .select(*by, "label", "n", F.array(*[F.col(f"_s{i}") for i in range(width)]).alias("sums"))
    )


def round_sums(cell_sums: DataFrame, plan: DataFrame, width: int) -> DataFrame:
    """Training sums of every hold-out round from sums per cell.

    ``plan`` is the hold-out plan: one row per cell.
    """
    train = cell_sums.join(F.broadcast(plan.select("cell", "train")), "cell").select(
        "label", "n", "sums", F.explode("train").alias("round")
    )
    return add_sums(train, width, ["round"])


def fold_sums(fold_level: DataFrame, width: int, k: int) -> DataFrame:
    """Training sums of every fold: all other folds."""
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_held")
    train = fold_level.select("fold", "label", "n", "sums", every).filter(F.col("fold") != F.col("_held"))
    return add_sums(train.drop("fold").withColumnRenamed("_held", "fold"), width, ["fold"])


def fit_from_sums(
    sums: DataFrame,
    width: int,
    by: Sequence[str] = (),
    smoothing: float | str = 1.0,
) -> DataFrame:
    """``(by..., label, n, pi, theta)``: log prior and log weight per position.

    ``smoothing`` is a number, or the name of a column in ``by``.
    """
    lam = F.col(smoothing) if isinstance(smoothing, str) else F.lit(float(smoothing))
    # one row per class in each window
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows, classes = F.sum("n").over(group), F.count(F.lit(1)).over(group)
    total = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
    return (
        sums.withColumn("_rows", rows)
        .withColumn("_classes", classes)
        .withColumn("_mass", total)
        .withColumn("_lam", lam)
        .select(
            *by,
            "label",
            "n",
            (
                F.log(F.col("n") + F.col("_lam"))
                - F.log(F.col("_rows") + F.col("_lam") * F.col("_classes"))
            ).alias("pi"),
            F.transform(
                "sums",
                lambda s: F.log(s + F.col("_lam")) - F.log(F.col("_mass") + F.col("_lam") * width),
            ).alias("theta"),
        )
    )


def fit(
    df: DataFrame,
    features: Features,
    label: str = "label",
    by: Sequence[str] = (),
    smoothing: float = 1.0,
) -> DataFrame:
    """Fit one model for each group of ``by``."""
    return fit_from_sums(class_sums(df, features, label, by), features.width, by, smoothing)


def weights(model: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., label, pi, pos, theta)``."""
    return model.select(*by, "label", "pi", F.posexplode("theta").alias("pos", "theta"))


def _one_row_models(model: DataFrame, by: Sequence[str], labels: Sequence[Any]) -> DataFrame:
    mine = [F.col("label") == F.lit(c) for c in labels]
    return model.groupBy(*by).agg(
        *[F.max(F.when(m, F.col("pi"))).alias(f"_pi{i}") for i, m in enumerate(mine)],
        *[F.first(F.when(m, F.col("theta")), True).alias(f"_th{i}") for i, m in enumerate(mine)],
    )


def score(
    df: DataFrame,
    model: DataFrame,
    features: Features,
    labels: Sequence[Any],
    by: Sequence[str] = (),
    models: int = 1,
    keep: Sequence[str] | None = None,
    probability_of: Any = None,
) -> DataFrame:
    """Score every row with the model of its group: ``(keep..., prediction)``.

    ``labels`` lists the classes in ascending order and ``models`` says how many
    groups ``model`` holds; together with the width they bound what is sent to
    each executor.  Classes a group was not trained on are never predicted, and
    ties go to the lowest class.  ``probability_of`` adds ``probability``.

    Models too large to send at once are sent in shares, each to its own rows:
    joining on the few group keys by a shuffle would pile rows up on a few tasks.
    """
    shares = -(-models * len(labels) * (features.width + 1) * 8 // MODEL_BYTES)
    if by and shares > 1 and models > 1:
        parts = min(shares, models)
        # one row per model: far smaller than the models themselves
        order = Window.partitionBy(F.lit(0)).orderBy(*by)
        share = ((F.row_number().over(order) - 1) % parts).alias("_share")
        dealt = F.broadcast(model.select(*by).distinct().select(*by, share))
        df, model = df.join(dealt, list(by)), model.join(dealt, list(by))
        mine = F.col("_share")
        done = [
            score(
                df.filter(mine == i).drop("_share"), model.filter(mine == i).drop("_share"),
                features, labels, by, -(-models // parts), keep, probability_of,
            )
            for i in range(parts)
        ]
        return reduce(DataFrame.unionByName, done)
    groups = list(by) or ["_all"]
    if not by:
        df, model = df.withColumn("_all", F.lit(0)), model.withColumn("_all", F.lit(0))
    kept = list(keep) if keep is not None else [c for c in df.columns if c != "_all"]
    small = shares <= 1
    opened, values = features.open(df)
    if len(labels) * features.width <= MAX_TERMS:
        flat = _one_row_models(model, groups, labels)
        joined = opened.join(F.broadcast(flat) if small else flat, groups)
        scores: list[Column] = []
        for i in range(len(labels)):
            total = F.col(f"_pi{i}")
            for j, v in enumerate(values):
                total = total + F.col(f"_th{i}")[j] * v
            scores.append(total)
        scored = joined.select(*kept, *[s.alias(f"_sc{i}") for i, s in enumerate(scores)])
        named = [F.col(f"_sc{i}") for i in range(len(labels))]
        best = F.greatest(*named) if len(named) > 1 else named[0]
        choice = F.coalesce(*[F.when(s == best, F.lit(c)) for s, c in zip(named, labels)])
        parts = [F.coalesce(F.exp(s - best), F.lit(0.0)) for s in named]
        total = sum(parts[1:], parts[0])
        mine = parts[list(labels).index(probability_of)] if probability_of is not None else None
    else:
        # too many terms to write out: loop over classes and positions in arrays
        packed = model.groupBy(*groups).agg(
            F.array_sort(F.collect_list(F.struct("label", "pi", "theta"))).alias("_models")
        )
        joined = opened.join(F.broadcast(packed) if small else packed, groups)
        x = F.array(*values)
        dot = F.transform(
            "_models",
            lambda m: F.struct(
                m["label"].alias("c"),
                F.aggregate(F.zip_with(m["theta"], x, lambda t, v: t * v), m["pi"], lambda a, p: a + p).alias("s"),
            ),
        )
        scored = joined.select(*kept, dot.alias("_dots"))
        scored = scored.withColumn("_best", F.array_max(F.transform("_dots", lambda d: d["s"])))
        choice = F.filter("_dots", lambda d: d["s"] == F.col("_best"))[0]["c"]
        total = F.aggregate("_dots", F.lit(0.0), lambda a, d: a + F.exp(d["s"] - F.col("_best")))
        if probability_of is not None:
            named = F.filter("_dots", lambda d: d["c"] == F.lit(probability_of))
            mine = F.coalesce(F.exp(F.get(named, F.lit(0))["s"] - F.col("_best")), F.lit(0.0))
    out = [choice.alias("prediction")]
    if probability_of is not None:
        out.append((mine / total).alias("probability"))
    return scored.select(*kept, *out)


def held_out_rows(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row once for every round in which its cell is held out: adds ``round``.

    ``plan`` is the hold-out plan: one row per cell.
    """
    held = df.join(F.broadcast(plan.select("cell", F.col("test").alias("_rounds"))), "cell")
    return held.withColumn("round", F.explode("_rounds")).drop("_rounds")
