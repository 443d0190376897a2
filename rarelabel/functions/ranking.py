"""Whole-table row numbers that no single task has to produce."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTITION_BITS = 33  # layout of monotonically_increasing_id


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's setting, else one for tests."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="rarelabel-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return f"{root}/{name}-{os.urandom(6).hex()}"


def number_in_order(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... in total ``order``, in parallel.

    Rows are range-partitioned and sorted, then checkpointed so that partition
    boundaries cannot move between the two passes.  Each row's number is its
    position in its partition plus the number of rows in earlier partitions.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    placed = df.orderBy(*order).checkpoint(eager=True)
    placed = placed.withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", _PARTITION_BITS)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    # one row per partition of ``placed``: a size the scheduler already holds
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(
            out,
            F.col("_offset") + F.col("_place").bitwiseAND((1 << _PARTITION_BITS) - 1),
        )
        .drop("_part", "_place", "_offset")
    )


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``scratch_path`` named, in whichever file system it lies."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
