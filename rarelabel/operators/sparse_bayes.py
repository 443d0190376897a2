"""Multinomial naive Bayes over very wide, sparse features.

Nothing here has a column, an array or an expression per position: rows are their
entries (position, value), sums are kept by (class, position), and only positions
that a class has seen have a weight of their own.  The weight of all others is one
number per class.  Scoring joins entries with weights by position: weights of up to
``BROADCAST_WEIGHTS`` meet the entries where they are, so a row's sums are made in its
task; more are joined by shuffle, the entries of a frequent position dealt in salted
parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ensure_checkpoint_dir

SALTS = 16
BROADCAST_WEIGHTS = 1_000_000  # about 50 MB; their number grows with positions and classes, not with rows


def entries(df: DataFrame, features: str) -> Column:
    """``array<struct<pos, value>>`` of a vector, or of such an array, without zeros.

    A null row, a null or negative value and NaN are errors: the model reads features
    as counts.
    """
    own = F.col(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        raw = F.unwrap_udt(own)
        sparse = raw["type"] == 0
        places = F.when(sparse, raw["indices"]).otherwise(F.sequence(F.lit(0), F.size(raw["values"]) - 1))
        # a vector without values has no places; ``sequence`` would count down to -1
        places = F.when(F.size(raw["values"]) == 0, F.array().cast("array<int>")).otherwise(places)
        pairs = F.zip_with(places, raw["values"], lambda p, v: F.struct(p.alias("pos"), v.alias("value")))
    else:
        pairs = F.transform(own, lambda e: F.struct(e["pos"].cast("int").alias("pos"), e["value"].cast("double").alias("value")))
    bad = F.exists(pairs, lambda e: e["value"].isNull() | F.isnan(e["value"]) | (e["value"] < 0) | e["pos"].isNull())
    error = lambda text: F.raise_error(F.lit(text)).cast("array<struct<pos:int,value:double>>")
    kept = F.filter(pairs, lambda e: e["value"] > 0)
    return F.when(own.isNull(), error("features are null")).when(bad, error("naive Bayes needs features that are not negative")).otherwise(kept)


@dataclass(frozen=True)
class SparseBayes:
    """``classes``: ``(by..., label, n, pi, unseen)``; ``weights``: ``(by..., pos, label, theta)`` of seen positions."""

    classes: DataFrame
    weights: DataFrame
    by: tuple[str, ...]


def fit(df: DataFrame, features: str, width: int, label: str = "label", by: Sequence[str] = (), smoothing: float = 1.0) -> SparseBayes:
    """One model for each group of ``by``, from two aggregations that combine in each task.

    Null labels are an error.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = list(by)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    own = F.coalesce(F.col(label), F.raise_error(F.lit(f"column {label} has null labels")).cast(df.schema[label].dataType)).alias("label")
    rows = df.select(*by, own, entries(df, features).alias("_e"))
    seen = rows.select(*by, "label", F.inline("_e")).groupBy(*by, "pos", "label").agg(F.sum("value").alias("s")).checkpoint()
    mass = seen.groupBy(*by, "label").agg(F.sum("s").alias("mass")).withColumnsRenamed({c: f"_{c}" for c in [*by, "label"]})
    counted = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
    same = F.lit(True)
    for c in [*by, "label"]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    lam = F.lit(float(smoothing))
    # one row per class in each window
    total = F.coalesce("mass", F.lit(0.0)) + lam * width
    classes = counted.join(mass, same, "left").select(
        *by, "label", "n", (F.log(F.col("n") + lam) - F.log(F.sum("n").over(group) + lam * F.count(F.lit(1)).over(group))).alias("pi"),
        (F.log(lam) - F.log(total)).alias("unseen"), total.alias("_total"),
    ).checkpoint()
    weights = seen.join(F.broadcast(classes.select(*by, "label", "_total")), [*by, "label"]).select(*by, "pos", "label", (F.log(F.col("s") + lam) - F.log("_total")).alias("theta"))
    return SparseBayes(classes.drop("_total"), weights, tuple(by))


def scores(df: DataFrame, model: SparseBayes, features: str, key: Sequence[str], salts: int = SALTS, broadcast_weights: int = BROADCAST_WEIGHTS) -> DataFrame:
    """``(by..., key..., class, score)``: log score of each row under each class of its group.

    ``key`` must tell rows apart.  A row without entries has the prior alone.
    """
    by = list(model.by)
    rows = df.select(*by, *key, entries(df, features).alias("_e"))
    long = rows.select(*by, *key, F.inline("_e")).withColumnRenamed("value", "_value")
    held = model.weights.join(F.broadcast(model.classes.select(*by, "label", "unseen")), [*by, "label"]).select(*by, "pos", F.struct("label", (F.col("theta") - F.col("unseen")).alias("more")).alias("_w"))
    held = held.groupBy(*by, "pos").agg(F.collect_list("_w").alias("_w"))
    if model.weights.count() <= broadcast_weights:
        met = long.join(F.broadcast(held), [*by, "pos"])
    else:
        salt = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(salts)).cast("int")
        held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = long.withColumn("_salt", salt).join(held, [*by, "pos", "_salt"])
    met = met.select(*by, *key, "_value", F.inline("_w"))
    more = met.groupBy(*by, *key, F.col("label").alias("class")).agg(F.sum(F.col("more") * F.col("_value")).alias("_more"))
    mass = F.aggregate("_e", F.lit(0.0), lambda a, e: a + e["value"]).alias("_mass")
    # one row per class and group
    every = rows.select(*by, *key, mass).join(F.broadcast(model.classes.select(*by, F.col("label").alias("class"), "pi", "unseen")), by) if by else rows.select(*key, mass).join(F.broadcast(model.classes.select(F.col("label").alias("class"), "pi", "unseen")))
    found = every.join(more, [*by, *key, "class"], "left")
    return found.select(*by, *key, "class", (F.col("pi") + F.col("unseen") * F.col("_mass") + F.coalesce("_more", F.lit(0.0))).alias("score"))


def predict(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by..., prediction)``: the class with the largest score, the lowest class if scores agree to nine digits."""
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), F.col("class").alias("c")))["c"]
    return scored.groupBy(*by).agg(best.alias("prediction"))
