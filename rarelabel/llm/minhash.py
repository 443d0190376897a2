"""Near duplicates by HyperMinHash.

1. Each text's shingle set gets compressed registers and band keys; texts with
   equal sets are one node from here on.
2. Rows that share a band key are candidates.  Each bucket's rows are first
   compared with the bucket's smallest row only, so no bucket is expanded into
   pairs: first the collision-corrected estimate from registers, then the full
   sets.  Links give components.
3. Buckets whose rows are still in several components are compared in full, but
   in blocks of bounded size: a task compares two blocks, skips rows already
   connected, and yields only links that join components, never pairs.

A pair at the threshold of 0.8 shares none of the 32 bands of 5 registers with
probability 3e-6; the estimate drops it with probability below 1e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyperminhash as sketch
from .common import bounded, numbered, row_number, salted_join, slices, stored, without
from .components import components

WORDS = 5
SIMILARITY = (80, 100)
BLOCK_ROWS, BLOCK_SHINGLES = 1_024, 1 << 20
ESTIMATE_SLACK = 4.5  # standard deviations below the threshold

_SKETCH = "row bigint, doc_id bigint, n_shingles bigint, set_id binary, bands array<bigint>"
_SETS = "row bigint, n bigint, shingles binary, registers binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``row, doc_id, n_shingles, set_id, bands``; empty sets have no id and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, ids, bands = [], [], []
            for t in batch.column(2).to_pylist():
                found = sketch.shingle_set(t, words)
                sizes.append(len(found))
                ids.append(sketch.set_id(found) if len(found) else None)
                bands.append(sketch.band_keys(sketch.registers(found)) if len(found) else [])
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "n_shingles", "set_id", "bands"])

    return docs.mapInArrow(run, _SKETCH)


def _full_sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sketch.shingle_set(t, words) for t in batch.column(1).to_pylist()]
            arrays = [
                batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()),
                pa.array([sketch.registers(s).tobytes() for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "n", "shingles", "registers"])

    return docs.select("row", "text").mapInArrow(run, _SETS)


class Judge:
    """Decides whether two sets are alike: by size, by estimate, and then in full."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        t = self.num / self.den
        self.least = t - ESTIMATE_SLACK * (t * (1 - t) / sketch.REGISTERS) ** 0.5

    def may_be(self, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        sized = np.minimum(n, m) * self.den >= np.maximum(n, m) * self.num
        return sized & (sketch.estimated_jaccard(equal, n, m) >= self.least)

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = np.concatenate([a, b])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common * self.den >= (len(both) - common) * self.num


def _verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` that are alike."""
    one, other = (sets.select(F.col("row").alias(c), F.col("shingles").alias(f"s_{c}"), F.col("registers").alias(f"r_{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(similarity)
        for batch in slices(batches):
            kept = []
            for sa, ra, sb, rb in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                equal = np.count_nonzero(np.frombuffer(ra, np.uint16) == np.frombuffer(rb, np.uint16))
                n, m = len(sa) // 8, len(sb) // 8
                kept.append(bool(judge.may_be(equal, n, m)) and judge.alike(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "s_a", "r_a", "s_b", "r_b").mapInArrow(run, "a bigint, b bigint")


def _block_links(rows: list[int], labels: list[int], sides: list[bool], marks: np.ndarray, sets: list[np.ndarray], band: int, judge: Judge, two: bool) -> list[tuple[int, int]]:
    """Links between components inside a block, or between two blocks.

    A pair is looked at in the first band it shares, so that other buckets of
    the same rows do not repeat the work.
    """
    parent = {c: c for c in labels}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if len(parent) < 2:
        return []
    sizes, kinds, side = np.array([len(s) for s in sets]), np.array(labels), np.array(sides)
    found: list[np.ndarray] = []  # per row i: (equal registers, i, j) of rows j that may be alike
    for i in range(len(rows) - 1):
        later = np.flatnonzero((kinds[i + 1 :] != kinds[i]) & ((side[i + 1 :] != side[i]) if two else True)) + i + 1
        if not len(later):
            continue
        same = marks[later] == marks[i]
        equal = same.sum(axis=1)
        ok = judge.may_be(equal, sizes[later], np.int64(sizes[i]))
        if ok.any():
            shared = same[ok].reshape(-1, sketch.BANDS, sketch.ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band
            pairs = np.empty((int(first.sum()), 3), np.int16)
            pairs[:, 0], pairs[:, 1], pairs[:, 2] = equal[ok][first], i, later[ok][first]
            found.append(pairs)
    links: list[tuple[int, int]] = []
    if not found:
        return links
    table = np.concatenate(found)
    for k in np.argsort(-table[:, 0], kind="stable"):  # the likeliest first, so that most others are connected already
        i, j = int(table[k, 1]), int(table[k, 2])
        a, b = root(labels[i]), root(labels[j])
        if a != b and judge.alike(sets[i], sets[j]):
            parent[max(a, b)] = min(a, b)
            links.append((rows[i], rows[j]))
    return links


def _between_components(members: DataFrame, linked: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links ``a, b`` among rows of buckets that hold several components."""
    labels = components(linked)
    held = members.join(labels.withColumnRenamed("node", "row"), "row", "left").join(sets.select("row", "n"), "row")
    held = held.select("key", "band", "row", F.coalesce("component", "row").alias("label"), "n")
    open_keys = held.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_sum"))
    blocks = F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_sum") / BLOCK_SHINGLES))
    open_keys = open_keys.where("_low <> _high").select("key", blocks.cast("int").alias("blocks"))
    dealt = held.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") <= F.col("other")).alias("side"), "row", "label")
    full = dealt.join(sets.select("row", "shingles", "registers"), "row")
    full = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "row")
    full = full.select("key", "lo", "hi", "band", "row", "label", "side", "shingles", "registers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(similarity)

        def links_of(group: tuple, held: list[tuple]) -> list[tuple[int, int]]:
            bands, rows, own, sides, shingles, marks = (list(c) for c in zip(*held, strict=True))
            table = np.frombuffer(b"".join(marks), np.uint16).reshape(len(rows), -1)
            return _block_links(rows, own, sides, table, [np.frombuffer(s, np.uint64) for s in shingles], bands[0], judge, group[1] != group[2])

        def shown(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        group, held = None, []
        for batch in slices(batches):
            links: list[tuple[int, int]] = []
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, lo, hi) != group:
                    if len(held) > 1:
                        links += links_of(group, held)
                    group, held = (key, lo, hi), []
                held.append(tuple(row))
            yield shown(links)
        if len(held) > 1:
            yield shown(links_of(group, held))

    return full.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
    """One row per input row: ``row, doc_id, n_shingles, component_id, stays``.

    Shingles are runs of ``words`` words with A-Z lower-cased; a text with fewer
    words is one shingle; a text without words, or null, is linked with nothing.
    Texts are linked if ``intersection / union`` of their sets is at least
    ``similarity``; ``component_id`` is the smallest id reachable over links.
    Null ids are larger than any; of each component exactly one row stays, the
    one with the smallest id (of repeated ids, the first row).  ``row`` is
    the column ``number`` of ``docs``, see ``common.numbered``; without one, texts
    are numbered and written first, as they are read twice.  An empty table gives
    no rows.
    """
    if number is None:
        docs, number = numbered(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
        id_col, text = "doc_id", "text"
    read = docs.select(row_number(number), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = stored(sketches(read, words))
    filled = seen.where("n_shingles > 0")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    classes = stored(filled.groupBy("set_id").agg(F.min("row").alias("node"), best, F.count(F.lit(1)).alias("rows")))
    copies = filled.join(bounded(classes.where("rows > 1").select("set_id", "node")), "set_id").where("row <> node").select("row")
    keyed = filled.join(bounded(stored(copies)), "row", "left_anti").select("row", F.posexplode("bands").alias("band", "key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("row").alias("leader"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    members = stored(keyed.join(bounded(buckets), "key"))
    candidates = stored(members.select("row").distinct())
    sets = stored(_full_sets(read.join(bounded(candidates), "row", "left_semi"), words))
    spokes = members.where("row <> leader").select(F.col("leader").alias("a"), F.col("row").alias("b")).distinct()
    links = stored(_verified(spokes, sets, similarity))
    links = stored(links.unionByName(_between_components(members.drop("leader"), links, sets, similarity)))
    labels = components(links).withColumnRenamed("node", "_node")
    labelled = stored(classes.join(labels, F.col("node") == F.col("_node"), "left").select("set_id", "best", "component"))
    linked = labelled.where("component is not null")
    ends = linked.groupBy("component").agg(F.min("best").alias("_least"))
    ends = salted_join(linked.select("set_id", "component"), ends, ["component"], F.col("set_id"), "inner").select("set_id", "_least")
    ends = ends.unionByName(labelled.where("component is null").select("set_id", F.col("best").alias("_least")))
    # a plain join of a few numbers a row: Spark splits a set that fills a partition
    found = filled.select("row", "doc_id", "n_shingles", "set_id").join(ends, "set_id")
    found = found.select("row", "doc_id", "n_shingles", F.col("_least.doc_id").alias("component_id"), (F.col("row") == F.col("_least.row")).alias("stays"))
    alone = seen.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return found.unionByName(alone)


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all of their columns."""
    counted, number = numbered(docs)
    return without(counted, number, near_duplicates(counted, words, similarity, id_col, text, number).where(~F.col("stays")).select("row"))
