"""Connected components by repeated contraction, all on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROWS_PER_PARTITION = 100_000
LAST_ROWS = 500_000  # two numbers each: 8 MB


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct nodes of links ``a, b``, and the smallest node each can reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := root[root], root):
            root = further
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _last_turn(edges: DataFrame) -> DataFrame:
    """``x, y``: the nodes of at most ``LAST_ROWS`` links and their components, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in smallest_reachable(*map(np.concatenate, zip(*held, strict=True)))], names=["x", "y"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "x bigint, y bigint")


def components(links: DataFrame, last_rows: int = LAST_ROWS) -> DataFrame:
    """``node, component`` (its smallest node) of every node in links ``a, b``.

    Each turn points a node to its smallest neighbour, if that is smaller, and
    follows these pointers to their roots, twice as far with each jump.  Links are
    then contracted to what remains between different roots; the number of nodes
    that still have links at least halves with each turn, and the tables of a turn are
    kept in as many partitions as its links need.  Once ``last_rows`` links or fewer
    are left, one task ends the work: turns of so few rows are many small jobs, and all
    they take is the driver's time and memory.  Loops and repeated links do no harm; no
    links give no rows.
    """
    def kept(df: DataFrame, rows: int) -> DataFrame:
        return stored(df.coalesce(max(1, -(-rows // ROWS_PER_PARTITION))))

    pairs = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(pairs.where("a <> b").distinct())
    size = every = edges.count()
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while size:
        if size <= last_rows:
            ends = _last_turn(edges)
            if size == every:  # the first turn: each node is still its own component
                return stored(ends.toDF("node", "component"))
            return kept(labels.join(ends, F.col("component") == F.col("x"), "left").select("node", F.coalesce("y", "component").alias("component")), every)
        point = edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y"))
        point = kept(point.select("x", F.least("x", "y").alias("y"), F.lit(True).alias("moved")), size)
        while not point.where("moved").isEmpty():
            jump = point.select(F.col("x").alias("y"), F.col("y").alias("z"))
            point = kept(point.join(jump, "y").select("x", F.col("z").alias("y"), (F.col("z") != F.col("y")).alias("moved")), size)
        labels = kept(labels.join(point, F.col("component") == F.col("x"), "left").select("node", F.coalesce("y", "component").alias("component")), every)
        left = point.select(F.col("x").alias("a"), F.col("y").alias("_a"))
        right = point.select(F.col("x").alias("b"), F.col("y").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = kept(moved.where("a <> b").distinct(), size)
        size = edges.count()
    return labels
