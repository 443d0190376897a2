"""Columnar tables, data-set variants, row ids and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import numeric_fields

# File-name patterns of the data-set variants.
_VARIANTS = {
    "original": "{name}.libsvmForm",
    "chisq": "{name}.Chisq.{k}.libsvmForm",
    "pca": "{name}.PCA.{k}.libsvmForm",
    "oversampling": "{name}oversampling.libsvmForm",
    "undersampling": "{name}undersampling.libsvmForm",
    "chisq_oversampling": "{name}.Chisq.{k}oversampling.libsvmForm",
    "pca_oversampling": "{name}.PCA.{k}oversampling.libsvmForm",
    "sized_undersampling": "{name}{k}.undersampling.libsvmForm",
    "parquet": "{name}.parquet",
    "model": "{name}.LR.model",
}


def dataset_path(root: str, name: str, variant: str = "original", k: int | None = None) -> str:
    """Path of a data-set variant, for example the top-``k`` chi-square columns."""
    pattern = _VARIANTS[variant]
    if ("{k}" in pattern) != (k is not None):
        raise ValueError(f"variant {variant} {'needs' if '{k}' in pattern else 'takes no'} k")
    return f"{root.rstrip('/')}/{pattern.format(name=name, k=k)}"


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Deal out the rows of a stored table with fewer pieces than there are cores.

    A single-file table is read by a single task; steps that compute much for
    each row should not stay there.  Tables in many pieces are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def with_row_id(df: DataFrame, path: str, out: str = "row_id") -> DataFrame:
    """Give rows without a key a stable one: number them and store the table.

    The stored table is what makes the ids stable; read it from now on.
    """
    write_parquet(df.withColumn(out, F.monotonically_increasing_id()), path)
    return df.sparkSession.read.parquet(path)


def profile(df: DataFrame, distinct: str = "approx") -> DataFrame:
    """One row per column: type, nulls, distinct values, smallest and largest number.

    ``distinct`` is ``approx`` (a sketch, one pass without a shuffle of values),
    ``exact`` or ``none``.
    """
    counters = {
        "approx": lambda c: F.approx_count_distinct(c),
        "exact": lambda c: F.count_distinct(c),
        "none": lambda c: F.lit(None).cast("bigint"),
    }
    if distinct not in counters:
        raise ValueError(f"distinct must be one of {sorted(counters)}")
    numeric = set(numeric_fields(df.schema))
    stats = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        number = c.cast("double") if field.name in numeric else F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count_if(c.isNull()).alias("nulls"),
                counters[distinct](c).alias("n_distinct"),
                F.min(number).alias("min_value"),
                F.max(number).alias("max_value"),
            )
        )
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def first_rows(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in key order: a per-task top-n, then one small merge."""
    return df.orderBy(*key).limit(n)
