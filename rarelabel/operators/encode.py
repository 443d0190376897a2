"""Strings, booleans and missing values to numbers; columns to one vector."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler, VectorIndexer, VectorIndexerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ensure_checkpoint_dir, number_in_order

MISSING = "__missing__"
SINGLE_TASK_VALUES = 1_000_000
BROADCAST_VALUES = 200_000
BROADCAST_BYTES = 64 << 20
_PARTS = 4_096


def missing_as_category(column: Column, tokens: Sequence[str] = ()) -> Column:
    """Null and every missing-value token become one category of their own."""
    kept = F.when(column.isin(*tokens), F.lit(None)).otherwise(column) if tokens else column
    return F.coalesce(kept, F.lit(MISSING))


def combine_flags(*names: str) -> Column:
    """One column from several alternatives: the largest value that is present."""
    return F.greatest(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(names[0])


@dataclass(frozen=True)
class Vocabulary:
    """Values of each string column, numbered by descending frequency.

    ``table`` has ``(column, value, n, idx)``; ``sizes`` counts values by column
    and ``heads`` says how many of them are small enough together to broadcast.
    """

    table: DataFrame
    sizes: dict[str, int]
    heads: dict[str, int]

    def values(self, column: str) -> DataFrame:
        return self.table.filter(F.col("column") == column).select("value", "n", "idx")

    def transform(self, df: DataFrame, unseen: str = "error") -> DataFrame:
        """Replace each column by its index, moved behind the other columns.

        ``unseen`` decides about null and unknown values: ``error``, ``skip``
        the row, or ``keep`` it under one index after the last.
        """
        if unseen not in ("error", "skip", "keep"):
            raise ValueError("unseen must be 'error', 'skip' or 'keep'")
        rest = [c for c in df.columns if c not in self.sizes]
        for column, size in self.sizes.items():
            df = self._attach(df, column, size)
            index = F.col(_index(column))
            if unseen == "skip":
                df = df.filter(index.isNotNull())
            elif unseen == "keep":
                df = df.withColumn(_index(column), F.coalesce(index, F.lit(float(size))))
            else:
                message = F.lit(f"column {column} holds a null or unknown value")
                df = df.withColumn(
                    _index(column), F.coalesce(index, F.raise_error(message).cast("double"))
                )
        return df.select(
            *[F.col(f"`{c}`") for c in rest],
            *[F.col(_index(c)).alias(c) for c in self.sizes],
        )

    def _attach(self, df: DataFrame, column: str, size: int) -> DataFrame:
        """One broadcast join, and for a large column one more join by shuffle; the input is read once."""
        index = _index(column)
        words = self.table.filter(F.col("column") == column).select(
            F.col("value").alias("_value"), F.col("idx").cast("double").alias(index)
        )
        match = F.col(f"`{column}`").cast("string") == F.col("_value")
        limit = self.heads[column]
        if size <= limit:
            return df.join(F.broadcast(words), match, "left").drop("_value")
        # Frequent values have the smallest indexes.  Rows whose value is one of the
        # first ``limit``, or null, are settled before the shuffle and dealt there by
        # a hash of the row to parts that hold no values, so no key is hot.
        head = words.filter(F.col(index) < limit).withColumnRenamed(index, "_head")
        # the part belongs to one key with the value: as a column of its own it would be seen to be constant
        tail = words.filter(F.col(index) >= limit).select(F.struct(F.col("_value").alias("v"), F.lit(0).alias("part")).alias("_key"), index)
        whole = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
        value = F.col(f"`{column}`").cast("string")
        settled = F.col("_head").isNotNull() | value.isNull()
        dealt = F.pmod(F.xxhash64(*whole), F.lit(_PARTS)).cast("int") + 1
        own = F.struct(F.when(~settled, value).alias("v"), F.when(settled, dealt).otherwise(F.lit(0)).alias("part"))
        tried = df.join(F.broadcast(head), match, "left").drop("_value").withColumn("_own", own)
        found = tried.join(tail, F.col("_own") == F.col("_key"), "left")
        return found.withColumn(index, F.coalesce("_head", index)).drop("_head", "_own", "_key")


def _index(column: str) -> str:
    return "_idx_" + "".join(f"{ord(ch):x}" if not ch.isalnum() else ch for ch in column)


def fit_vocabulary(
    df: DataFrame,
    columns: Sequence[str],
    single_task_values: int = SINGLE_TASK_VALUES,
    broadcast_values: int = BROADCAST_VALUES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Vocabulary:
    """Number the values of all ``columns`` in one pass over the table.

    Index 0 is the most frequent value; equal counts are ordered by value.
    Booleans are indexed by their text.  At most ``broadcast_values`` values of a
    column are ever broadcast, and those of all columns together take at most
    ``broadcast_bytes``, each counted as long as its column's longest.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in columns
        ]
    )
    counts = (
        df.select(F.explode(cells).alias("c"))
        .select("c.column", "c.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .checkpoint(eager=True)
    )
    measured = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("values"), F.max(F.octet_length("value")).alias("longest")
    )
    found = {r["column"]: r for r in measured.collect()}
    sizes = {c: found[c]["values"] if c in found else 0 for c in columns}
    cost = {c: found[c]["longest"] + 64 if c in found else 64 for c in columns}
    # columns that need little leave the rest of their share to others
    heads, left = {}, broadcast_bytes
    for done, c in enumerate(sorted(columns, key=lambda c: (sizes[c] * cost[c], c))):
        heads[c] = min(sizes[c], broadcast_values, left // (len(columns) - done) // cost[c])
        left -= heads[c] * cost[c]
    order = [F.col("n").desc(), F.col("value").asc()]
    if max(sizes.values(), default=0) <= single_task_values:
        within = Window.partitionBy("column").orderBy(*order)
        table = counts.withColumn("idx", (F.row_number().over(within) - 1).cast("bigint"))
    else:
        placed = number_in_order(counts, [F.col("column").asc(), *order], "_number")
        start, seen = F.lit(0), 0
        for column in sorted(columns):
            start = F.when(F.col("column") == column, seen).otherwise(start)
            seen += sizes[column]
        table = placed.select("column", "value", "n", (F.col("_number") - start).alias("idx"))
    return Vocabulary(table, sizes, heads)


def assemble(
    df: DataFrame,
    names: Sequence[str],
    label: str = "label",
    keep: Sequence[str] = (),
    on_null: str = "error",
) -> DataFrame:
    """``(keep..., label, features)`` from scalar columns, one vector per row."""
    made = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid=on_null)
    return made.transform(df).select(*keep, F.col(label).cast("double").alias("label"), "features")


def fit_categories(df: DataFrame, features: str = "features", limit: int = 20) -> VectorIndexerModel:
    """Find positions with at most ``limit`` distinct values.

    Tasks keep no more than ``limit`` values per position, so continuous
    columns cost nothing extra.  Fit it on training rows.
    """
    return VectorIndexer(
        inputCol=features, outputCol="indexedFeatures", maxCategories=limit, handleInvalid="keep"
    ).fit(df)


def category_table(df: DataFrame, model: VectorIndexerModel) -> DataFrame:
    """``(pos, value, idx)`` of a fitted category model: at most limit rows per position."""
    rows = [
        (int(pos), float(value), int(idx))
        for pos, values in model.categoryMaps.items()
        for value, idx in values.items()
    ]
    return df.sparkSession.createDataFrame(rows, "pos int, value double, idx int")
