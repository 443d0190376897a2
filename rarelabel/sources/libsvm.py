"""LIBSVM text: ``label index:value ...`` with 1-based positions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``(label double, features vector)``.

    ``width`` is required: the text does not store trailing zeros, and without
    it the reader makes an extra pass only to guess the width.
    """
    return spark.read.format("libsvm").option("numFeatures", str(width)).load(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label", features: str = "features") -> None:
    """Write ``(label, features)``, replacing old output."""
    df.select(F.col(label).cast("double").alias("label"), F.col(features).alias("features")).write.mode(
        "overwrite"
    ).format("libsvm").save(path)


def to_dense(df: DataFrame, features: str = "features") -> DataFrame:
    """Make every vector dense, so that its width travels with each row."""
    return df.withColumn(features, array_to_vector(vector_to_array(features)))
