"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of characters; of each window of w hashes the
smallest is selected, the rightmost on ties; each selected place is kept once.
Two texts that share ``w + k - 1`` characters or more share a selected hash.
Numpy does the work on one text at a time, in time linear in its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 20
WINDOW = 48
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BATCH_ROWS, _BATCH_CHARS = 1_000, 4_000_000


class _Powers:
    """Powers of the base and of its inverse, as far as any text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _UNBASE))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all grams; a shorter text is one gram; an empty one none."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(gram, n)
    up, down = _powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashed = (sums[size:] - sums[: n - size + 1]) * down[: n - size + 1]
    hashed ^= hashed >> np.uint64(31)
    hashed *= _MIX
    hashed ^= hashed >> np.uint64(29)
    return (hashed * _MIX) >> np.uint64(32)


def select(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of window minima, ascending, each once; rightmost on ties."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    # smaller hash first; of equal hashes the larger place has the smaller key
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    w = min(window, n)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    places = 0xFFFFFFFF - (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def fingerprint(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the selected grams in order of place."""
    hashes = gram_hashes(code_points(text), gram)
    places = select(hashes, window)
    return hashes[places].astype(np.uint32), places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes; two empty fingerprints are alike (1), an empty and another not (0)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes array<bigint>, places array<int>`` of each row, without a shuffle.

    Null and empty texts have empty arrays; texts shorter than a gram one hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "", gram, window) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "hashes", "places"])

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id bigint, hashes array<bigint>, places array<int>")


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", groups_per_partition: int = 8) -> DataFrame:
    """Rows in ascending order of id, in groups that each end with the row that follows them.

    Gives ``_group, doc_id, text, _extra``, sorted within partitions; a row with
    ``_extra`` only serves as the next of the row before it.  After the last row
    comes the first.  Null ids come first; equal ids are ordered by a hash of the
    text.  Ids are cut into ranges at quantiles, so whole texts are shuffled once
    and no task holds more than its ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = max(2, groups_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(F.col("doc_id").cast("double")).na.drop().approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    # a cut to double keeps the order of ids, so equal cuts never part a range wrongly
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    keyed = rows.withColumn("_at", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))
    keyed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket").transform(keyed)
    keyed = keyed.select(F.col("_bucket").cast("int").alias("_group"), "doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_tie"))
    firsts = keyed.groupBy("_group").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    # one row per range: ``groups_per_partition`` times the number of shuffle partitions
    around = Window.orderBy("_group")
    firsts = firsts.select("_group", "_first", F.coalesce(F.lag("_group").over(around), F.max("_group").over(Window.partitionBy())).alias("_before"))
    same = keyed["_group"].eqNullSafe(firsts["_group"]) & keyed["doc_id"].eqNullSafe(firsts["_first.doc_id"]) & (keyed["_tie"] == firsts["_first._tie"])
    extra = keyed.join(F.broadcast(firsts), same).dropDuplicates(["_before"])
    extra = extra.select(F.col("_before").alias("_group"), "doc_id", "text", "_tie", F.lit(True).alias("_extra"))
    both = keyed.withColumn("_extra", F.lit(False)).unionByName(extra)
    placed = both.repartition("_group").sortWithinPartitions("_group", "_extra", "doc_id", "_tie")
    return placed.select("_group", "doc_id", "text", "_extra")


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Edited: the last quarter (rounded down) of the characters is replaced by as
    many first characters of the next document.  ``fingerprint`` is base64 of the
    hashes in order of place, 32 bits each, little-endian.  Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda h: base64.b64encode(h.astype("<u4").tobytes()).decode()
        out: list[tuple] = []
        chars, last = 0, None  # last: group, id, text, hashes, distinct hashes

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _EDITED, strict=True)], schema=_EDITED)

        for batch in batches:
            for group, doc_id, t, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = t or ""
                hashes = fingerprint(t, gram, window)[0]
                distinct = np.unique(hashes)
                if last is not None and last[0] == group:
                    _, own_id, own, own_hashes, own_distinct = last
                    quarter = len(own) // 4
                    edited = own[: len(own) - quarter] + t[:quarter]
                    changed = fingerprint(edited, gram, window)[0]
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    out.append((own_id, len(own), digest, shown(own_hashes), shown(changed), likeness(own_distinct, np.unique(changed)), likeness(own_distinct, distinct)))
                    chars += len(own)
                    if len(out) >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                        yield batch_of(out)
                        out, chars = [], 0
                last = None if extra else (group, doc_id, t, hashes, distinct)
        if out:
            yield batch_of(out)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text).mapInArrow(run, schema)
