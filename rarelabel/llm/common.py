"""What several text operators need: exact text rules and lineage cuts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarelabel.functions.ranking import ensure_checkpoint_dir, scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    A text without characters beyond ASCII can take the fast general ``lower``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep it in the shared checkpoint folder.

    Later steps read these files, so a lost executor costs no recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def salted_join(left: DataFrame, right: DataFrame, key: list[str], spread: Column, how: str, salts: int = 32) -> DataFrame:
    """Join where one key may hold a large share of ``left``.

    Rows of ``left`` are dealt to ``salts`` parts of their key by ``spread``; the
    rows of ``right`` (one per key) are repeated for each part.
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*key, "_salt"], how).drop("_salt")


BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of a few numbers a row: broadcast while it has at most ``rows`` rows.

    Beyond that it is joined by shuffle; the answer is the same.
    """
    return F.broadcast(df) if df.count() <= rows else df


SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``SLICE_ROWS``, without copying them.

    A Python worker lives as long as its executor and keeps what its largest batch
    took, so it makes objects of few rows at a time, however many Spark sends at once.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(first, SLICE_ROWS)


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A small table of the driver's.

    From Arrow: a list of Python rows would go through Python workers of another
    kind than those of ``mapInArrow``, and these then stay on every executor as well.
    """
    return spark.createDataFrame(table)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_ROW_BITS = 33  # rows of one file


def _reads_files(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is one row of a file: a read table, maybe with columns and rows left out."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with its rows numbered, the same in every pass, and the column's name.

    How a table's files are split depends on the cores that are alive, so numbers
    by partition are not the same twice.  A row of a Parquet table is numbered by
    its file, in order of path, and its place in that file; nothing is written.
    Any other table is numbered and written once, and all passes read the written one.
    """
    name = fresh(docs, "_row_number")
    if _reads_files(docs):
        path, place = fresh(docs, "_file"), fresh(docs, "_place")
        about = docs.metadataColumn("_metadata")
        try:
            placed = docs.select("*", about["file_path"].alias(path), about["row_index"].alias(place))
        except AnalysisException:  # files of a kind that does not number its rows
            placed = None
        if placed is not None:
            paths = sorted(r[0] for r in placed.select(path).distinct().collect())
            # one row for each file of the table, as the driver's listing has it
            places = [k << _ROW_BITS for k in range(len(paths))]
            files = local_table(docs.sparkSession, pa.table({path: pa.array(paths, pa.string()), name: pa.array(places, pa.int64())}))
            return placed.join(F.broadcast(files), path).select(*docs.columns, (F.col(name) + F.col(place)).alias(name)), name
    written = scratch_path(docs.sparkSession, "numbered")
    docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(written)
    return docs.sparkSession.read.parquet(written), name


def row_number(number: str | None) -> Column:
    """``row`` of an operator: the stored numbers in column ``number``, else new ones for a single pass."""
    return (F.col(number) if number else F.monotonically_increasing_id()).alias("row")


def without(counted: DataFrame, number: str, rows: DataFrame) -> DataFrame:
    """``counted`` without the numbers in ``rows`` (one column) and without its column ``number``."""
    gone = stored(rows.toDF(number))
    return counted.join(bounded(gone), number, "left_anti").drop(number)
