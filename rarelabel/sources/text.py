"""Whitespace-delimited text, read through a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TableSchema

_FIELDS = "_fields"
REASON = "reason"


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def split_lines(lines: DataFrame) -> DataFrame:
    """Split each non-blank line on runs of whitespace, ignoring outer blanks."""
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    return lines.select(text.alias("value")).filter(F.col("value") != "").select(
        F.split("value", " ").alias(_FIELDS)
    )


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return split_lines(spark.read.text(path))


def raw_table(fields: DataFrame, schema: TableSchema) -> DataFrame:
    """Rows of the right width under the all-string schema."""
    return fields.filter(F.size(_FIELDS) == len(schema.names)).select(
        *[F.col(_FIELDS)[i].alias(n) for i, n in enumerate(schema.names)]
    )


def clean_missing(column: Column, missing: Sequence[str]) -> Column:
    """Null where the text is one of the missing-value tokens."""
    return F.when(column.isin(*missing), F.lit(None)).otherwise(column) if missing else column


def type_columns(raw: DataFrame, schema: TableSchema, missing: Sequence[str] = ()) -> DataFrame:
    """Cast numeric columns, keep the rest as text; one projection in all.

    A malformed number becomes null, as ``rejected_rows`` reports.
    """
    numeric = set(schema.numeric)
    return raw.select(
        *[
            clean_missing(_quoted(n), missing).try_cast("double").alias(n)
            if n in numeric
            else clean_missing(_quoted(n), missing).alias(n)
            for n in schema.names
        ]
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: TableSchema,
    missing: Sequence[str] = (),
    require: Sequence[str] = (),
    empty: str | None = None,
) -> DataFrame:
    """Text to typed rows.  ``require`` names columns whose nulls drop the row.

    ``empty`` is the token that stands for an empty string in text columns.
    """
    typed = type_columns(raw_table(read_fields(spark, path), schema), schema, missing)
    if empty is not None:
        texts = [n for n in schema.names if n not in set(schema.numeric)]
        typed = typed.withColumns({n: F.when(_quoted(n) == empty, "").otherwise(_quoted(n)) for n in texts})
    return typed.dropna(subset=list(require)) if require else typed


def rejected_rows(
    spark: SparkSession, path: str, schema: TableSchema, missing: Sequence[str] = ()
) -> DataFrame:
    """Lines that do not fit the schema: ``(reason, fields)``.

    Reasons: ``too_few_fields``, ``too_many_fields``, ``bad_number``.
    """
    fields = read_fields(spark, path)
    width = F.size(_FIELDS)
    bad = F.lit(False)
    for i, field in enumerate(schema.names):
        if field in set(schema.numeric):
            text = clean_missing(F.col(_FIELDS)[i], missing)
            bad = bad | (text.isNotNull() & text.try_cast("double").isNull())
    reason = (
        F.when(width < len(schema.names), "too_few_fields")
        .when(width > len(schema.names), "too_many_fields")
        .when(bad, "bad_number")
    )
    return fields.select(reason.alias(REASON), F.col(_FIELDS).alias("fields")).filter(
        F.col(REASON).isNotNull()
    )


def write_table(df: DataFrame, path: str, missing: str = "NA", empty: str = "''", blanks: str = "error") -> None:
    """Write every column as text, one line per row.

    A null is written as ``missing`` and an empty string as ``empty``, so that
    each line has all its fields; a value that equals either token is an error.
    So is a blank inside a value, which would be read back as two fields;
    ``blanks="underscore"`` writes ``_`` instead, where values may merge.
    """
    if blanks not in ("error", "underscore"):
        raise ValueError(f"blanks is {blanks!r}, neither 'error' nor 'underscore'")
    error = F.raise_error(F.lit(f"a value equals the token {missing} or {empty}")).cast("string")
    blank = F.raise_error(F.lit("a value holds a blank")).cast("string")

    def cell(name: str) -> Column:
        text = _quoted(name).cast("string")
        whole = F.regexp_replace(text, r"\s", "_") if blanks == "underscore" else F.when(text.rlike(r"\s"), blank).otherwise(text)
        shown = F.when(text.isin(missing, empty), error).when(text == "", empty)
        return F.when(text.isNull(), missing).otherwise(shown.otherwise(whole))

    cells = [cell(n) for n in df.columns]
    df.select(F.concat_ws(" ", *cells).alias("value")).write.mode("overwrite").text(path)
