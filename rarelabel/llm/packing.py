"""Best-fit packing of token sequences, bulk-synchronous.

Lengths are whole numbers from 1 to the capacity, so range-sorted documents, and
range-sorted gaps, are runs of equal numbers: at most ``capacity`` runs each,
however many documents there are.  Spark counts the documents of each length.
Rounds then go over runs: documents of the next length sweep the sorted gaps for
their successor (the tightest gap that still holds them), a whole run takes a
whole run of gaps at a time, conflicts over a run are resolved by rank (lower
ranks get the gap, the rest go on to the next successor), gaps are updated, and
the next round follows.  The outcome is exactly that of best-fit decreasing.

Rounds yield a plan, ``ranks a to b of length s go to sequences c to d at offset
o``, and Spark applies it to all documents by rank in one join.  The driver sees
counts by length only.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_table, slices, stored
from .tokens import byte_ids

CAPACITY = 2048
END_ID = 0
PLAN_BROADCAST_ROWS = 200_000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
Step = tuple[int, int, int, int, int, int]  # size, first rank, count, first sequence, per sequence, offset


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than ``capacity``."""
    head = length % capacity
    starts = ([0] if head else []) + list(range(head, length, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all documents, one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = byte_ids(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.ids(t) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = zip(*out, strict=True) if out else [[]] * len(_PIECES_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES_ARROW, strict=True)], schema=_PIECES_ARROW)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _PIECES)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """The rounds of the module's text, over runs of lengths and gaps.

    ``gaps`` maps a gap to the runs of sequences that have it, as (first
    sequence, count); sequences of a run are alike.
    """
    plan: list[Step] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # gaps that have runs, sorted
    opened = 0

    def give(gap: int, first: int, count: int) -> None:
        if not gap or not count:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, count))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect.bisect_left(order, size)
            if k == len(order):  # no gap holds it: open as many sequences as the rest needs
                per = capacity // size
                give(capacity, opened, -(-left // per))
                opened += -(-left // per)
                continue
            gap = order[k]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            per = gap // size
            full, rest = min(count, left // per), 0
            if full:
                plan.append((size, rank, full * per, first, per, capacity - gap))
                give(gap - per * size, first, full)
            rank, left = rank + full * per, left - full * per
            if left and full < count:  # the last sequence of the run takes what is left
                rest = left
                plan.append((size, rank, rest, first + full, rest, capacity - gap))
                give(gap - rest * size, first + full, 1)
                rank, left = rank + rest, 0
            give(gap, first + full + bool(rest), count - full - bool(rest))
    return plan


def place(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored rows that have a ``length``.

    Ranks within a length are given in 64 parts side by side, so that one
    frequent length does not go through one task.
    """
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(64))
    dealt = items.withColumn("_part", part)
    sizes = dealt.groupBy("length", "_part").count()  # at most capacity * 64 rows
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored(sizes.withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = best_fit_plan(counts, capacity)
    columns = [pa.array(c, pa.int64()) for c in zip(*(steps or [(1, 0, 0, 0, 1, 0)]), strict=True)]
    plan = local_table(spark, pa.table(columns, names=["length", "_first", "_count", "_sequence", "_per", "_used"]))
    if len(steps) <= PLAN_BROADCAST_ROWS:
        plan = F.broadcast(plan)
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(sizes.drop("count")), ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    inside = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    met = ranked.join(plan.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & inside)
    place_in = F.col("_rank") - F.col("_first")
    return met.select(
        *items.columns,
        (F.col("_sequence") + F.floor(place_in / F.col("_per"))).cast("bigint").alias("sequence_id"),
        (F.col("_used") + place_in % F.col("_per") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its place there.

    A document is its token ids and ``end_id``; only documents longer than
    ``capacity`` are cut, and only their first piece may be shorter.  A null text
    is empty and takes one token.  Null and repeated ids are separate documents;
    an empty table gives no rows.
    """
    items = stored(pieces(docs, tokenizer_path, id_col, text, capacity, end_id))
    return place(docs.sparkSession, items, capacity)
