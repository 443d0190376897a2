"""Exact dedup: two passes around a Bloom filter of repeated hashes.

Pass one sets, in a blocked Bloom filter, only positions that two or more rows
hit.  A row can have a copy only if all of its positions are set.  Pass two
tests every row against the filter: rows that fail have no copy and go straight
through, and only the others are shuffled and grouped by the hash of their text.
A false positive of the filter costs a shuffled row, never a wrong answer.

The filter takes ``BITS_PER_ROW`` bits a row, so it grows with the table.  It is
broadcast in segments of at most ``segment_bytes``; each segment tests the rows
whose block it holds, from the stored table of hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, row_number, salted_join, stored, without

BLOCK_BITS = 32_768  # what one value of bitmap_construct_agg holds
BITS_PER_ROW = 16
SEGMENT_BYTES = 32 << 20
_SEEDS = (11, 12)


def text_hash(text: Column) -> Column:
    """SHA-256, as bytes, of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


def _positions(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(s)), F.lit(BLOCK_BITS)) for s in _SEEDS]


def repeated_filter(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits): the positions that at least two rows hit."""
    places = rows.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_positions(F.col(key)))).alias("place"))
    hit = places.groupBy("block", "place").count().where("count > 1")
    return hit.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))


def possibly_repeated(rows: DataFrame, key: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Add ``maybe``: false only if no other row has the same key.

    ``rows`` must be a stored table.  No row is shuffled.
    """
    blocks = max(1, math.ceil(rows.count() * BITS_PER_ROW / BLOCK_BITS))
    bits = stored(repeated_filter(rows, key, blocks))
    width = max(1, segment_bytes // (BLOCK_BITS // 8))
    placed = rows.withColumn("block", _block(F.col(key), blocks))
    parts = []
    for low in range(0, blocks, width):
        inside = F.col("block").between(low, low + width - 1)
        # at most ``segment_bytes``: the segment has ``width`` blocks of 4 KiB
        part = placed.where(inside).join(F.broadcast(bits.where(inside)), "block", "left")
        tests = [_is_set(F.col("bits"), p) for p in _positions(F.col(key))]
        parts.append(part.withColumn("maybe", tests[0] & tests[1]).drop("block", "bits"))
    tested = parts[0]
    for part in parts[1:]:
        tested = tested.unionByName(part)
    return tested


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES, number: str | None = None) -> DataFrame:
    """One row per input row: ``row, doc_id, text_sha256, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.
    Of equal texts the row with the largest id stays; a null id is smaller than
    any; among repeated rows of one id exactly one stays.  ``row`` is the
    column ``number`` of ``docs``, see ``common.numbered``, or a number of this
    pass only.  An empty table gives no rows.
    """
    hashed = stored(
        docs.select(
            row_number(number),
            F.col(id_col).cast("bigint").alias("doc_id"),
            text_hash(F.col(text)).alias("text_hash"),
        )
    )
    tested = possibly_repeated(hashed, "text_hash", segment_bytes)
    shown = F.lower(F.hex("text_hash")).alias("text_sha256")
    alone = tested.where(~F.col("maybe")).select(
        "row", "doc_id", shown, F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept")
    )
    maybe = tested.where("maybe").drop("maybe")
    groups = maybe.groupBy("text_hash").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    # only groups of several rows are dealt in salted parts
    own = F.struct("doc_id", "row")
    met = salted_join(maybe, groups.where("group_size > 1"), ["text_hash"], F.col("row"), "left").withColumn("best", F.coalesce("best", own))
    size = F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size")
    found = met.select("row", "doc_id", shown, F.col("best.doc_id").alias("keep_id"), size, (F.col("row") == F.col("best.row")).alias("kept"))
    return alone.unionByName(found)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns.

    Only numbers of dropped rows travel; see ``common.bounded``.
    """
    counted, number = numbered(docs)
    return without(counted, number, duplicate_groups(counted, id_col, text, number=number).where(~F.col("kept")).select("row"))
