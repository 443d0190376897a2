"""Product codes of vectors: exact k-means per part, with norm-of-sum bounds.

Vectors are cut into equal parts, and each part position has a codebook of its
own.  Every part keeps its entry, an upper bound of the distance to it and a
lower bound of the distance to all other entries, each with the round in which
it was true.  The codebooks of all rounds are kept: a bound of round r is
carried to round t by the true distance between an entry's places in r and t.
That net displacement is at most the sum of the drifts in between, and mostly
less.  While the lower bound exceeds the upper one, no distance is computed;
otherwise first the distance to the own entry is, and only if that does not
settle it all entries are scanned anew.

All distances are exact integers.  Bounds are floats rounded outward, and only
a strict inequality skips a scan, so ties go to the lower index as in a full scan.
A round writes the state of all rows and then removes that of the round before;
the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarelabel.functions.ranking import remove_path, scratch_path

from .common import bounded, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
_SLACK = 1e-6  # covers the rounding of bounds to 32-bit floats
_BOUND = np.dtype([("owner", "u1"), ("upper", "<f4"), ("upper_round", "u1"), ("lower", "<f4"), ("lower_round", "u1")])
_STATE = "vec_id bigint, label string, units binary, bounds binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, vector`` of rows whose vector is there and has only finite components."""
    read = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return read.where(F.col("vector").isNotNull() & finite)


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of ``matrix``."""
    width = matrix.dtype.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _matrix(column: pa.Array, dtype: np.dtype | str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width).copy()


def whole_units(vectors: list[list[float]], dimension: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of each component.

    Raises on a vector of another dimension and on a component so large that a
    squared distance would not fit 64 bits.
    """
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"a vector has {len(v)} components, the one with the smallest id {dimension}")
    units = np.floor(np.array(vectors, np.float64).reshape(len(vectors), dimension) * scale)
    limit = min((1 << 31) - 1, math.isqrt((1 << 62) // max(1, dimension)) // 2)
    if units.size and np.abs(units).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}")
    return units.astype(np.int64)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries."""
    out = np.empty((len(x), len(entries)), np.int64)
    for j, entry in enumerate(entries):
        out[:, j] = np.square(x - entry).sum(axis=1)
    return out


def reassign(x: np.ndarray, bounds: np.ndarray, history: list[np.ndarray]) -> int:
    """Bring ``bounds`` of one part position to the last codebook of ``history``; gives the number of full scans."""
    now, entries = len(history) - 1, history[-1]
    rows = np.arange(len(x))
    if now:
        # by round: how far each entry has come since, and how far the farthest of all others
        moved = np.array([np.sqrt(np.square(entries - old).sum(axis=1).astype(np.float64)) for old in history]) * (1 + _SLACK)
        top = np.argsort(moved, axis=1)
        farthest = np.repeat(moved.max(axis=1, keepdims=True), len(entries), axis=1)
        each = np.arange(len(history))
        farthest[each, top[:, -1]] = moved[each, top[:, -2]] if len(entries) > 1 else 0.0
        owner = bounds["owner"]
        upper = bounds["upper"] + moved[bounds["upper_round"], owner]
        lower = bounds["lower"] - farthest[bounds["lower_round"], owner]
        rows = np.flatnonzero(lower <= upper)
        own = np.sqrt(np.square(x[rows] - entries[owner[rows]]).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
        bounds["upper"][rows], bounds["upper_round"][rows] = own, now
        rows = rows[lower[rows] <= own]
    found = distances(x[rows], entries)
    owner = found.argmin(axis=1)  # the first of equal ones
    nearest = found[np.arange(len(rows)), owner]
    found[np.arange(len(rows)), owner] = np.iinfo(np.int64).max
    second = np.sqrt(found.min(axis=1, initial=np.iinfo(np.int64).max).astype(np.float64))
    for name, values in (("owner", owner), ("upper", np.sqrt(nearest.astype(np.float64)) * (1 + _SLACK)), ("upper_round", now), ("lower", second * (1 - _SLACK)), ("lower_round", now)):
        column = bounds[name]
        column[rows] = values
    return len(rows)


class Codes:
    """``rows`` (vec_id, label, owner of each part as bytes, error) and the final codebooks, (parts, entries, components)."""

    def __init__(self, rows: DataFrame, books: np.ndarray):
        self.rows, self.books = rows, books

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codes of all rows with a finite vector; others are left out.

    Codebooks start at the ``entries`` smallest ids (null ids last, repeated ids
    by their components); with fewer rows they are shorter.  Repeated rows and
    ids are rows of their own.  Each round assigns every part to the nearest
    entry, then moves entries to the floor of their mean; unused entries stay.
    All vectors must have the dimension of the one with the smallest id, a
    multiple of ``parts``; a component whose squared distances would not fit 64
    bits is an error.  An empty table gives no rows and empty codebooks.
    """
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector, label)
    first = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    dimension = len(first[0]) if first else 0
    if dimension % parts:
        raise ValueError(f"{dimension} components cannot be cut into {parts} equal parts")
    width = dimension // parts
    start = whole_units(first, dimension, parts, scale).reshape(len(first), parts, width).transpose(1, 0, 2)
    history = [np.ascontiguousarray(start)]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = whole_units(batch.column(2).to_pylist(), dimension, parts, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(units.astype("<i4")), _binary(np.zeros((len(units), parts), _BOUND))], names=["vec_id", "label", "units", "bounds"])

    def step(state: DataFrame) -> DataFrame:
        books = [h.copy() for h in history]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                units = _matrix(batch.column(2), "<i4", dimension).astype(np.int64)
                bounds = _matrix(batch.column(3), _BOUND, parts)
                for p in range(parts):
                    own = bounds[:, p].copy()
                    reassign(units[:, p * width : (p + 1) * width], own, [b[p] for b in books])
                    bounds[:, p] = own
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _binary(bounds)], names=["vec_id", "label", "units", "bounds"])

        return state.mapInArrow(run, _STATE)

    def means(state: DataFrame) -> np.ndarray:
        last = history[-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals, counts = np.zeros(last.shape, np.int64), np.zeros(last.shape[:2], np.int64)
            for batch in batches:
                units = _matrix(batch.column(0), "<i4", dimension)
                owners = _matrix(batch.column(1), _BOUND, parts)["owner"]
                for p in range(parts):
                    np.add.at(totals[p], owners[:, p], units[:, p * width : (p + 1) * width])
                    counts[p] += np.bincount(owners[:, p], minlength=last.shape[1])
            p, j = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(j, pa.int32()), pa.array(counts[p, j]), pa.array(totals[p, j].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "totals"])

        # one row for each part, entry and component, however many rows the table has
        sums = state.select("units", "bounds").mapInArrow(run, "part int, entry int, n bigint, totals array<bigint>")
        sums = sums.select("part", "entry", "n", F.posexplode("totals").alias("place", "total")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        out = last.copy()
        for r in sums.collect():
            out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
        return out

    state, old = kept.mapInArrow(begin, _STATE), None
    for turn in range(rounds + 1):
        path = scratch_path(spark, "vector-codes")
        step(state).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if old:
            remove_path(spark, old)
        old = path
        if turn < rounds:
            history.append(means(state))
    final = history[-1]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column(2), "<i4", dimension).astype(np.int64).reshape(-1, parts, width)
            owners = _matrix(batch.column(3), _BOUND, parts)["owner"]
            error = np.zeros(len(units), np.int64)
            for p in range(parts):
                error += np.square(units[:, p] - final[p][owners[:, p]]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(np.ascontiguousarray(owners)), pa.array(error)], names=["vec_id", "label", "owners", "error"])

    return Codes(state.mapInArrow(close, "vec_id bigint, label string, owners binary, error bigint"), final)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Add ``label_error``, the error summed over rows of one label; null labels are one.

    Only sums by label travel: broadcast while there are few, joined with skewed
    labels split otherwise.
    """
    sums = stored(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    return rows.join(bounded(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
