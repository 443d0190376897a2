"""Access to features whether they are scalar columns or one vector column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Features:
    """``names`` of scalar columns, or one ``vector`` (or array) column of ``width``."""

    names: tuple[str, ...]
    vector: str | None = None

    @classmethod
    def columns(cls, names: Sequence[str]) -> Features:
        return cls(tuple(names))

    @classmethod
    def of_vector(cls, name: str, width: int) -> Features:
        return cls(tuple(f"{name}_{i}" for i in range(width)), name)

    @property
    def width(self) -> int:
        return len(self.names)

    def open(self, df: DataFrame, out: str = "_x") -> tuple[DataFrame, list[Column]]:
        """Return ``df`` and one double expression per position.

        A vector is unpacked once into the helper column ``out``.
        """
        if self.vector is None:
            return df, [F.col(f"`{n}`").cast("double") for n in self.names]
        source = F.col(self.vector)
        if isinstance(df.schema[self.vector].dataType, VectorUDT):
            source = vector_to_array(source)
        return df.withColumn(out, source), [F.col(out)[i].cast("double") for i in range(self.width)]

    def long(self, df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
        """Long form ``(keep..., pos, value)``: one narrow row per position."""
        if self.vector is not None:
            source = F.col(self.vector)
            if isinstance(df.schema[self.vector].dataType, VectorUDT):
                source = vector_to_array(source)
        else:
            source = F.array(*[F.col(f"`{n}`").cast("double") for n in self.names])
        return df.select(*keep, F.posexplode(source).alias("pos", "value")).withColumn(
            "value", F.col("value").cast("double")
        )


def vector_width(df: DataFrame, vector: str) -> int:
    """Vector length, from column metadata when it is there, else from one row."""
    meta = df.schema[vector].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    if "numFeatures" in df.schema[vector].metadata:
        return int(df.schema[vector].metadata["numFeatures"])
    row = df.select(F.size(vector_to_array(vector)).alias("w")).first()
    if row is None:
        raise ValueError("cannot read a vector width from an empty table")
    return int(row["w"])


def feature_names(df: DataFrame, label: str, exclude: Sequence[str] = ()) -> list[str]:
    """All columns but the label and ``exclude`` (row ids, outcome columns)."""
    missing = set(exclude) - set(df.columns)
    if missing:
        raise ValueError(f"excluded columns not in the table: {sorted(missing)}")
    return [c for c in df.columns if c != label and c not in set(exclude)]


def numeric_fields(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType)]
