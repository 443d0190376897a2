"""Whole imports: text to typed table, typed table to labelled vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import feature_names
from ..operators.counts import class_histogram
from ..operators.encode import Vocabulary, assemble, fit_vocabulary, missing_as_category
from ..sources.libsvm import write_libsvm
from ..sources.schemas import TableSchema
from ..sources.tables import write_parquet
from ..sources.text import read_table, rejected_rows


@dataclass(frozen=True)
class Imported:
    table: DataFrame
    vocabulary: Vocabulary | None
    histogram: DataFrame
    rejected: dict[str, int] = field(default_factory=dict)


def encode_table(
    typed: DataFrame, schema: TableSchema, missing_category: bool = True, unseen: str = "keep"
) -> tuple[DataFrame, Vocabulary | None]:
    """Index all string and boolean columns: numeric columns first, then these."""
    if not schema.indexed:
        return typed, None
    if missing_category:
        typed = typed.select(
            *[
                missing_as_category(F.col(f"`{n}`")).alias(n) if n in schema.indexed else F.col(f"`{n}`")
                for n in schema.names
            ]
        )
    vocabulary = fit_vocabulary(typed, schema.indexed)
    return vocabulary.transform(typed, unseen).select(
        *[F.col(f"`{n}`") for n in schema.encoded_order]
    ), vocabulary


def import_text(
    spark: SparkSession,
    path: str,
    schema: TableSchema,
    out: str,
    missing: Sequence[str] = (),
    require: Sequence[str] = (),
    missing_category: bool = True,
    on_bad: str = "error",
) -> Imported:
    """Text to an all-double Parquet table, replacing what was at ``out``.

    Lines that do not fit the schema (wrong width, malformed number) are an error,
    or with ``on_bad="divert"`` are written next to the table, as
    ``<out>.rejected``, and counted by reason; of these, lines of the right width
    stay in the table with null for the malformed number.  Three passes over the text: one
    to judge lines, one to count string values, one to write.  The class
    histogram reads the written table.
    """
    if on_bad not in ("error", "divert"):
        raise ValueError(f"on_bad is {on_bad!r}, neither 'error' nor 'divert'")
    bad = rejected_rows(spark, path, schema, missing)
    if on_bad == "divert":
        write_parquet(bad, f"{out}.rejected")
        bad = spark.read.parquet(f"{out}.rejected")
    rejected = {r["reason"]: r["count"] for r in bad.groupBy("reason").count().collect()}
    if rejected and on_bad == "error":
        raise ValueError(f"lines that do not fit the schema: {rejected}")
    typed = read_table(spark, path, schema, missing, require)
    encoded, vocabulary = encode_table(typed, schema, missing_category)
    write_parquet(encoded, out)
    table = spark.read.parquet(out)
    return Imported(table, vocabulary, class_histogram(table, f"`{schema.label}`"), rejected)


def export_vectors(
    table: DataFrame,
    path: str,
    label: str = "label",
    exclude: Sequence[str] = (),
    on_null: str = "error",
) -> list[str]:
    """Write ``(label, features)`` as LIBSVM; returns the feature names by position."""
    names = feature_names(table, label, exclude)
    write_libsvm(assemble(table, names, label, on_null=on_null), path)
    return names
