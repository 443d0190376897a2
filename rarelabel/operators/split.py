"""Repeatable splits, folds and repeated hold-outs from row hashes.

None of these shuffles: each is one expression of the row key.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import as_columns, below, uniform_hash

MAX_PLAN_ENTRIES = 10_000_000


def _key_hash(key: str | Sequence[str], seed: int) -> Column:
    """Hash of a row's key; a null key is an error, or all its rows would fall together."""
    names = as_columns(key)
    missing = F.col(names[0]).isNull()
    for name in names[1:]:
        missing = missing | F.col(name).isNull()
    error = F.raise_error(F.lit(f"the key ({', '.join(names)}) is null")).cast("bigint")
    return F.when(missing, error).otherwise(uniform_hash(*names, seed=seed))


def split_column(key: str | Sequence[str], weights: Sequence[float], seed: int) -> Column:
    """Number of the split a row falls in; ``weights`` are normalised to sum 1."""
    total = float(sum(weights))
    edges = [below(min(1.0, edge / total)) for edge in accumulate(weights)]
    hashed = _key_hash(key, seed)
    # ``hashed`` is written once: the comparison runs over a literal array
    return F.least(
        F.size(F.filter(F.array(*[F.lit(e) for e in edges[:-1]]), lambda e: e <= hashed)),
        F.lit(len(edges) - 1),
    ) if len(edges) > 2 else F.when(hashed < edges[0], 0).otherwise(1)


def split_rows(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int,
    weights: Sequence[float] = (0.8, 0.2),
) -> list[DataFrame]:
    """Disjoint, complete parts of ``df`` in proportion to ``weights``."""
    tagged = df.withColumn("_split", split_column(key, weights, seed))
    return [tagged.filter(F.col("_split") == i).drop("_split") for i in range(len(weights))]


def with_side(
    df: DataFrame, key: str | Sequence[str], seed: int, train: float = 0.8, out: str = "side"
) -> DataFrame:
    """Mark each row ``train`` or ``test``."""
    hashed = _key_hash(key, seed)
    return df.withColumn(out, F.when(hashed < below(train), "train").otherwise("test"))


def _remainder(key: str | Sequence[str], n: int, seed: int) -> Column:
    number = (_key_hash(key, seed) % n).cast("int")
    # ``%`` counts as nullable, and joins would hash again to filter nulls
    return F.coalesce(number, F.lit(0))


def with_fold(
    df: DataFrame, key: str | Sequence[str], k: int, seed: int, out: str = "fold"
) -> DataFrame:
    """Mark each row with a fold 0..k-1, fit for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(out, _remainder(key, k, seed))


def with_cell(
    df: DataFrame, key: str | Sequence[str], cells: int, seed: int, out: str = "cell"
) -> DataFrame:
    """Spread rows over ``cells`` random groups, the units of repeated hold-outs.

    Sums kept per cell serve every round and fold, so the rows are read once
    instead of once per round.
    """
    return df.withColumn(out, _remainder(key, cells, seed))


def cell_is_test(cell: Column | str, round_id: Column | str, test: float, seed: int) -> Column:
    """Whether a cell is held out in a round."""
    return uniform_hash(cell, round_id, seed=seed) < below(test)


def holdout_plan(spark: SparkSession, rounds: int, cells: int, test: float, seed: int) -> DataFrame:
    """``(cell, train, test)``: the rounds in which a cell is trained on or held out.

    It has ``cells`` rows and ``cells * rounds`` entries, whatever the size of the
    table it is joined to.
    """
    if cells * rounds > MAX_PLAN_ENTRIES:
        raise ValueError(f"{cells} cells and {rounds} rounds make too large a plan; use fewer cells")
    tasks = max(1, cells * rounds // 50_000)
    every = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    held = cell_is_test("cell", "round", test, seed)
    return (
        spark.range(0, cells, 1, tasks)
        .select(F.col("id").cast("int").alias("cell"), every)
        .withColumn("_held", held)
        .groupBy("cell")
        .agg(
            F.collect_list(F.when(~F.col("_held"), F.col("round"))).alias("train"),
            F.collect_list(F.when(F.col("_held"), F.col("round"))).alias("test"),
        )
    )


def round_rows(cell_table: DataFrame, plan: DataFrame) -> DataFrame:
    """Each row of a per-cell table once for every round: adds ``(round, held_out)``."""

    def tagged(side: str, held: bool) -> Column:
        return F.transform(side, lambda r: F.struct(r.alias("round"), F.lit(held).alias("held_out")))

    sides = F.concat(tagged("train", False), tagged("test", True))
    return cell_table.join(F.broadcast(plan), "cell").select(*cell_table.columns, F.inline(sides))
