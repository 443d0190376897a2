"""Principal components and the covariance they come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128
_ROWS = 16_384


def covariance(df: DataFrame, features: str = "features", block: int = BLOCK) -> DataFrame:
    """``(i, j, cov)`` for i <= j: sample covariance of vector positions.

    A first pass takes the means, around which the second one multiplies.  Tasks
    hold some rows and one block of positions by positions at a time; blocks are
    added up by Spark, so neither the driver nor a task holds the whole matrix.  A
    null vector is an error; with fewer than two rows all values are null.
    """
    if df.isEmpty():
        return df.sparkSession.createDataFrame([], "i int, j int, cov double")
    middle = df.select(Summarizer.metrics("mean").summary(F.col(features)).alias("s")).select("s.mean").first()
    mean = np.array(middle["mean"].toArray())
    width = len(mean)
    starts = range(0, width, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column(0).null_count:
                raise ValueError("a vector is null")
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean
            for at in range(0, len(x), _ROWS):
                part = x[at : at + _ROWS]
                for a in starts:
                    for b in starts[a // block :]:
                        left, right = part[:, a : a + block], part[:, b : b + block]
                        sums = [left.T @ right, left.sum(axis=0), right.sum(axis=0)]
                        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([len(part)]), *(pa.array([s.ravel()], pa.list_(pa.float64())) for s in sums)], names=["a", "b", "n", "products", "left", "right"])

    def merge(table: pa.Table) -> pa.Table:
        """One block from its parts, as rows (i, j, cov)."""
        a, b, n = table["a"][0].as_py(), table["b"][0].as_py(), sum(table["n"].to_pylist())
        products, left, right = (np.sum(np.array(table[c].to_pylist()), axis=0) for c in ("products", "left", "right"))
        found = (products.reshape(len(left), len(right)) - np.outer(left, right) / n) / (n - 1) if n > 1 else np.full((len(left), len(right)), np.nan)
        i, j = np.indices(found.shape)
        keep = i + a <= j + b
        return pa.table({"i": (i[keep] + a).astype(np.int32), "j": (j[keep] + b).astype(np.int32), "cov": pa.array(found[keep], from_pandas=True)})

    arrays = df.select(vector_to_array(features).alias("x"))
    parts = arrays.mapInArrow(run, "a int, b int, n bigint, products array<double>, left array<double>, right array<double>")
    return parts.groupBy("a", "b").applyInArrow(merge, "i int, j int, cov double")


def fit_pca(df: DataFrame, k: int, features: str = "features", out: str = "pca") -> PCAModel:
    return PCA(k=k, inputCol=features, outputCol=out).fit(df)


def pca_project(
    df: DataFrame, model: PCAModel, features: str = "features", center: bool = False
) -> DataFrame:
    """Replace ``features`` by its components.

    By default the projection is not mean-centred; ``center=True`` subtracts
    the column means of ``df`` first.
    """
    if center:
        scaler = StandardScaler(
            inputCol=features, outputCol="_centred", withMean=True, withStd=False
        ).fit(df)
        df = scaler.transform(df).drop(features).withColumnRenamed("_centred", features)
    out = model.getOutputCol()
    return model.transform(df).drop(features).withColumnRenamed(out, features)


def component_table(df: DataFrame, model: PCAModel) -> DataFrame:
    """``(component, pos, weight, explained)`` of a fitted model."""
    weights = model.pc.toArray()
    share = model.explainedVariance.toArray()
    rows = [
        (c, p, float(weights[p, c]), float(share[c]))
        for c in range(weights.shape[1])
        for p in range(weights.shape[0])
    ]
    return df.sparkSession.createDataFrame(
        rows, "component int, pos int, weight double, explained double"
    )


def spectrum(df: DataFrame, model: PCAModel, features: str = "features") -> DataFrame:
    """``(component, eigenvalue, residual, length)``: how well a fitted model solves C v = lambda v.

    C is ``covariance``; ``residual`` is the length of C v - lambda v, and ``length``
    that of v.  One row per entry of C is joined with the model's weights by position.
    """
    weights = component_table(df, model).select("component", "pos", "weight")
    upper = covariance(df, features).checkpoint()
    whole = upper.unionByName(upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    turned = whole.join(weights.withColumnRenamed("pos", "j"), "j").groupBy("component", F.col("i").alias("pos")).agg(F.sum(F.col("cov") * F.col("weight")).alias("image"))
    both = turned.join(weights, ["component", "pos"])
    values = both.groupBy("component").agg(F.sum(F.col("image") * F.col("weight")).alias("eigenvalue"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    left = both.join(F.broadcast(values), "component")
    gap = F.col("image") - F.col("eigenvalue") * F.col("weight")
    return left.groupBy("component").agg(F.first("eigenvalue").alias("eigenvalue"), F.sqrt(F.sum(gap * gap)).alias("residual"), F.first("length").alias("length"))
