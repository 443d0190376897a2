"""Windows of units (words or lines) that also start earlier.

A window of ``window`` units is a repeat if the same units also start at an
earlier place: a smaller document id, or the same document further left.  Equal
windows hold the same seed, the smallest hash among their grams of ``gram``
units (rightmost on ties), at the same offset.  So rows are made per seed, about
two for each ``window - gram + 2`` units, not per window; a row carries 64-bit
prints of the windows around its seed, which extend a match to both sides.

Windows that repeat one of their own document are known without a lookup; a row
with no others is dealt by a hash of its place, so a text that says one thing
over and over does not fill one block.  Other rows are dealt by seed, so each
shuffle partition is an index block that holds every window that could equal one
of its own.  Seeds that occur once are dropped
there.  Where anchors are kept (lines), a seed that holds many rows is not kept in
one task: its windows are grouped by their own hash, with partial sums, and joined
back in salted parts.  For words a seed's rows meet in one task, sorted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import salted_join, stored
from .winnow import _MIX, _powers, select

PRINT_BYTES = 8
_OFFSET_BITS = 8
_ANCHORS = "seed bigint, doc_id bigint, tie bigint, place bigint, prints binary, known bigint"
_NOT_BLANK = re.compile(rb"[^\x20\x09-\x0D]")
Split = Callable[[str], list[bytes]]


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def lines_of(text: str) -> list[bytes]:
    """Lines that are not blank, without white space (space, tab to carriage return) at their ends."""
    return [u for line in text.encode().split(b"\n") if (u := line.strip())]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size``."""
    n = len(hashes)
    up, down = _powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return _mixed(_mixed((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1]))


def unit_hashes(units: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(u) for u in units], np.uint64)


def seeds_of(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Seed, first window and offset of each run of windows with one seed, and prints of all windows."""
    if len(hashes) < window:
        return None
    grams = _rolling(hashes, gram)
    reach = window - gram + 1
    n = len(hashes) - window + 1
    picked = select(grams >> np.uint64(32), reach)
    # the window that starts at i has the first picked place at or after i that is the minimum of its reach;
    # a place stays the minimum until a later one is smaller or it leaves the window
    keys = ((grams >> np.uint64(32)) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
    firsts = _first_windows(keys, picked, reach)
    return grams[picked], firsts, picked - firsts, _rolling(hashes, window)[:n]


def _first_windows(keys: np.ndarray, picked: np.ndarray, reach: int) -> np.ndarray:
    """First window in which each picked place is the minimum.

    It is the window that reaches the place, unless an earlier picked place is
    smaller and still inside; then the window after that place.
    """
    firsts = np.maximum(picked - reach + 1, 0)
    if len(picked) > 1:
        earlier_is_smaller = keys[picked[:-1]] < keys[picked[1:]]
        firsts[1:] = np.where(earlier_is_smaller, picked[:-1] + 1, firsts[1:])
    return firsts


def known_windows(marks: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of windows, which repeat an earlier window of the text (bits), and whether all do."""
    _, earliest = np.unique(marks, return_index=True)
    bits = np.zeros(len(first), np.int64)
    if len(earliest) == len(marks):
        return bits, np.zeros(len(first), bool)
    again = np.ones(len(marks), bool)
    again[earliest] = False
    at = np.flatnonzero(again)
    run = np.searchsorted(first, at, side="right") - 1
    np.bitwise_or.at(bits, run, np.int64(1) << (at - first[run]))
    return bits, np.bincount(run, minlength=len(first)) == size


def _anchors(docs: DataFrame, split: Split, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, ids, ties, places, prints, sizes, null, known = [], [], [], [], [], [], [], []
            for doc_id, tie, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = seeds_of(unit_hashes(split(text or "")), window, gram) if text else None
                if found is None:
                    continue
                seed, first, offset, marks = found
                place = (first << _OFFSET_BITS) | offset
                size = np.diff(np.append(first, len(marks)))
                again, whole = known_windows(marks, first, size)
                if whole.any():
                    seed = np.where(whole, _mixed(place.astype(np.uint64) ^ np.uint64(((doc_id or 0) ^ tie) & 0xFFFFFFFFFFFFFFFF)), seed)
                known.append(again)
                seeds.append(seed.view(np.int64))
                ids.append(np.full(len(seed), doc_id or 0, np.int64))
                ties.append(np.full(len(seed), tie, np.int64))
                null.append(np.full(len(seed), doc_id is None))
                places.append(place)
                sizes.append(size * PRINT_BYTES)
                prints.append(np.ascontiguousarray(marks).view(np.uint8))
            if not seeds:
                continue
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(prints))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(seeds)), pa.array(np.concatenate(ids), mask=np.concatenate(null)), pa.array(np.concatenate(ties)), pa.array(np.concatenate(places).astype(np.int64)), packed, pa.array(np.concatenate(known))],
                names=["seed", "doc_id", "tie", "place", "prints", "known"],
            )

    return docs.select("doc_id", "tie", "text").mapInArrow(run, _ANCHORS)


def _prepared(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), F.col(text).cast("string").alias("text"))


def _windows(anchors: DataFrame) -> DataFrame:
    """One row per window: the anchor's columns, its ``i``, ``offset``, ``print`` and ``own`` (its place, comparable)."""
    n = (F.octet_length("prints") / PRINT_BYTES).cast("int")
    rows = anchors.select("seed", "doc_id", "tie", "place", "known", "prints", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    own = F.struct("doc_id", "tie", (F.shiftright("place", _OFFSET_BITS) + F.col("i")).alias("at"))
    offset = F.col("place").bitwiseAND((1 << _OFFSET_BITS) - 1) - F.col("i")
    mark = F.substring(F.col("prints"), F.col("i") * PRINT_BYTES + 1, F.lit(PRINT_BYTES))
    return rows.select("seed", "doc_id", "tie", "place", "known", "i", offset.alias("offset"), mark.alias("print"), own.alias("own"))


def _masks(windows: DataFrame) -> DataFrame:
    """One row per anchor with repeats: bit i of ``mask`` is set if its window i is one."""
    bit = F.when(F.col("own") > F.col("first"), F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("bigint"))
    found = windows.groupBy("seed", "doc_id", "tie", "place").agg(F.bit_or(F.col("known").bitwiseOR(bit)).alias("mask"))
    return found.where("mask <> 0")


def repeat_masks(anchors: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``doc_id, tie, place, mask`` of anchors that have repeated windows.

    ``hot``: a broadcastable table of seeds that hold very many rows, or None.
    """
    same = ["seed", "offset", "print"]
    cold = anchors if hot is None else anchors.join(hot, "seed", "left_anti")
    several = cold.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("seed"))).where("_n > 1 or known <> 0")
    found = _masks(_windows(several).withColumn("first", F.min("own").over(Window.partitionBy(*same))))
    if hot is not None:
        frequent = _windows(anchors.join(hot, "seed", "left_semi"))
        firsts = frequent.groupBy(*same).agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        met = salted_join(frequent, firsts, same, F.col("own"), "left").withColumn("first", F.coalesce("first", "own"))
        found = found.unionByName(_masks(met))
    return found.select("doc_id", "tie", "place", "mask")


def hot_seeds(anchors: DataFrame, share: int = 4) -> DataFrame:
    """Seeds with more rows than a ``share``-th of an even shuffle partition: at most ``share`` times as many as partitions."""
    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(anchors.groupBy("seed").count().where("count > 32"))
    total = anchors.count()
    return F.broadcast(stored(counted.where(F.col("count") > total / (parts * share)).select("seed")))


_HIT_BITS = 26  # 2048 bitmaps of 4 KB: 8 MB broadcast, whatever the table


def _hits(by_doc: DataFrame, key: Column) -> DataFrame:
    """``_part, _bits``: the hashed keys of ``by_doc`` as bitmaps, of bounded size in all."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << _HIT_BITS)).alias("_place")
    return by_doc.select(place).groupBy(F.bitmap_bucket_number("_place").alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))


def _marked(read: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``doc_id, tie, text, _hit``: 0 where a row of ``read`` has no masks, 1 where it has, or shares its bit with one that has."""
    hits = F.broadcast(stored(_hits(by_doc, F.struct("_id", "_tie"))))
    placed = read.withColumn("_place", F.pmod(F.xxhash64(F.struct("doc_id", "tie")), F.lit(1 << _HIT_BITS)))
    met = placed.withColumn("_part", F.bitmap_bucket_number("_place")).join(hits, "_part", "left")
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1)
    return met.select("doc_id", "tie", "text", F.coalesce(bit, F.lit(0)).alias("_hit"))


def _with_masks(read: DataFrame, by_doc: DataFrame) -> DataFrame:
    """``doc_id, text, packed`` of each row of ``read``; ``packed`` is null where ``by_doc`` has none.

    Only texts that may have repeats are shuffled to their masks, as a bitmap of
    hashed ids tells: a few are shuffled in vain, none is missed.  The larger the
    table, the more bits are shared, up to all texts being shuffled.
    """
    marked = _marked(read, by_doc)
    met = marked.where("_hit = 1").join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left")
    return met.select("doc_id", "text", "packed").unionByName(marked.where("_hit = 0").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("packed")))


_KEPT = "doc_id bigint, n_units bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept_text string"


def covered(n: int, packed: list[int], window: int, reach: int) -> np.ndarray:
    """Which of n units a repeated window covers; ``packed``: start of an anchor's first window and mask."""
    change = np.zeros(n + 1, np.int32)
    if packed:
        codes = np.array(packed, np.int64)
        first, mask = codes >> reach, codes & ((1 << reach) - 1)
        for i in range(reach):
            starts = first[(mask >> i) & 1 == 1] + i
            np.add.at(change, starts, 1)
            np.add.at(change, starts + window, -1)
    return np.cumsum(change[:-1]) > 0


def spans_of(gone: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def _join_words(text: str, gone: np.ndarray) -> str:
    units = text.encode().split()
    return b" ".join([u for u, g in zip(units, gone.tolist(), strict=True) if not g]).decode()


def _join_lines(text: str, gone: np.ndarray) -> str:
    out, at = [], 0
    for line in text.encode().split(b"\n"):
        if _NOT_BLANK.search(line):
            at += 1
            if gone[at - 1]:
                continue
        out.append(line)
    return b"\n".join(out).decode()


def without_repeats(docs: DataFrame, unit: str, window: int, gram: int, id_col: str = "doc_id", text: str = "text", keep_anchors: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_units, n_removed, spans, kept_text``.

    ``spans`` are maximal runs of removed units, (start, length) from 0.  Repeats
    are judged on the input.  Equal ids are ordered by a 64-bit hash of their text, and
    rows with equal id and text count as one document.  Null ids come first; null
    texts have no units and stay null-free (empty), and an empty table gives no rows.
    ``keep_anchors`` stores the
    seeds' rows, for units that are few, and splits seeds that hold many of them.
    """
    split, join = {"word": (words_of, _join_words), "line": (lines_of, _join_lines)}[unit]
    reach = window - gram + 1
    read = _prepared(docs, id_col, text)
    anchors = _anchors(read, split, window, gram)
    if keep_anchors:
        anchors = stored(anchors)
    found = repeat_masks(anchors, hot_seeds(anchors) if keep_anchors else None)
    packed = F.shiftleft(F.shiftright("place", _OFFSET_BITS), reach).bitwiseOR(F.col("mask"))
    by_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_list(packed).alias("packed"))
    met = _with_masks(read, stored(by_doc))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for t, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = t or ""
                n = len(split(t))
                gone = covered(n, codes or [], window, reach)
                runs = spans_of(gone) if codes else []
                counts.append(n)
                removed.append(sum(b for _, b in runs))
                spans.append([{"start": a, "length": b} for a, b in runs])
                kept.append(join(t, gone))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_units", "n_removed", "spans", "kept_text"])

    return met.mapInArrow(run, _KEPT)


