"""Jaccard join of shingle sets with PartEnum signatures.  Exact.

Sets are dealt to bands of about equal size.  Two sets of a band that are alike
differ in at most k shingles, k by the band's largest size.  A band cuts the domain
of shingle hashes into ceil((k + 1) / 2) first-level parts; in one of them at most
one shingle differs.  Each is cut into three second-level parts, and each two of the
three are enumerated as a subset: a signature is a hash of a set's shingles in one
subset.  At most one of the three parts differs, so alike sets share a signature.  A
set that may be alike with a set of the next band also has that band's signatures.

1. One pass takes each text's set, its identity and its signatures; equal sets are
   one node from here on.
2. Nodes that share a signature with the smallest node of that signature form a
   family, the connected component of such pairs: no signature is expanded into
   pairs, and every alike pair is inside a family.
3. Families are dealt to blocks of bounded size, and the smallest node of the family
   is put in each: a task intersects full sets inside its block and yields links
   that join components, never pairs.
4. Families of several blocks that are still in several components are compared
   block by block, in the same way.

Step 4 takes time with the square of a large family whose sets stay unlinked, spread
over many tasks; all other steps grow with the number of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hyperminhash as sketch
from .common import BROADCAST_ROWS, salted_join, stored
from .components import components
from .repeats import _mixed

WORDS = 3
SIMILARITY = (90, 100)
PARTS = 3  # second-level parts; each subset leaves out one
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 1 << 20
_SEEN = "doc_id bigint, n_shingles bigint, set_id binary, keys array<bigint>, host int"
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Bands:
    """Bands of set sizes, and how many shingles alike sets of a band can differ in."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        if not 0 < self.num <= self.den:
            raise ValueError(f"a similarity of {self.num} / {self.den} is outside (0, 1]")
        self._last: list[int] = []  # the largest size of each band

    def band(self, size: int) -> int:
        while not self._last or self._last[-1] < size:
            low = self._last[-1] + 1 if self._last else 1
            self._last.append(max(low, low * self.den**2 // self.num**2))
        return int(np.searchsorted(self._last, size))

    def largest(self, band: int) -> int:
        while len(self._last) <= band:
            self.band(self._last[-1] + 1 if self._last else 1)
        return self._last[band]

    def bands(self, size: int) -> list[int]:
        """The band of a set, and the next one if an alike set can be in it."""
        own = self.band(size)
        return [own, own + 1] if size * self.den >= (self.largest(own) + 1) * self.num else [own]

    def differences(self, band: int) -> int:
        """Shingles that are in one of two alike sets but not in both, at most."""
        return 2 * self.largest(band) * (self.den - self.num) // (self.den + self.num)


@lru_cache(256)
def _cuts(parts: int) -> np.ndarray:
    """Where the range of 64-bit hashes is cut into equal parts."""
    return np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)


def signatures(shingles: np.ndarray, band: int, differences: int) -> np.ndarray:
    """int64 signatures of a set in a band; none where alike sets are equal."""
    if not differences:
        return np.zeros(0, np.int64)
    first = differences // 2 + 1
    spread = np.sort(_mixed(_mixed(shingles * _SALT + np.uint64(1))))  # uniform, so parts are ranges
    edges = np.searchsorted(spread, _cuts(first * PARTS))
    sums = np.zeros(len(spread) + 1, np.uint64)
    np.cumsum(_mixed(spread + _SALT), out=sums[1:])
    held = np.diff(sums[np.concatenate([[0], edges, [len(spread)]])]).reshape(first, PARTS)
    subsets = held.sum(axis=1, dtype=np.uint64)[:, None] - held  # the sum over all parts but one
    place = np.arange(first * PARTS, dtype=np.uint64).reshape(first, PARTS) + (np.uint64(band + 1) << np.uint64(40))
    return _mixed(_mixed(subsets + _mixed(place * _SALT))).ravel().view(np.int64)


def _sketches(docs: DataFrame, words: int, similarity: tuple[int, int]) -> DataFrame:
    """One row per document: its set's size, identity and signatures; the first ``host`` ones are of its own band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for batch in batches:
            sizes, ids, keys, hosts = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = sketch.shingle_set(text, words)
                own = [signatures(found, b, bands.differences(b)) for b in bands.bands(len(found))] if len(found) else [np.zeros(0, np.int64)]
                sizes.append(len(found))
                ids.append(sketch.set_id(found) if len(found) else None)
                hosts.append(len(own[0]))
                keys.append(np.concatenate(own))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(hosts, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_id", "keys", "host"])

    return docs.mapInArrow(run, _SEEN)


def _with_sets(rows: DataFrame, read: DataFrame, words: int) -> DataFrame:
    """``rows`` with ``shingles``, from the texts that have an id in ``least``.

    Where ids repeat, more texts are read and told apart by their sets; a task
    yields a set once.
    """
    held = stored(rows)
    around = F.broadcast if held.count() <= BROADCAST_ROWS else lambda df: df
    wanted = held.select(F.col("least").alias("_least")).distinct()
    texts = read.join(around(wanted), F.col("doc_id").eqNullSafe(F.col("_least")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            ids, sets = [], []
            for text in batch.column(0).to_pylist():
                found = sketch.shingle_set(text, words)
                if len(found) and (own := sketch.set_id(found)) not in known:
                    known.add(own)
                    ids.append(own)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["set_id", "shingles"])

    return texts.select("text").mapInArrow(run, "set_id binary, shingles binary").join(around(held), "set_id")


def links_in_block(nodes: list[int], labels: list[int], sides: list[bool], sets: list[np.ndarray], similarity: tuple[int, int], two: bool) -> list[tuple[int, int]]:
    """Links between components of a block, or between its two sides; full sets decide.

    One row's set is marked in the block's vocabulary and counted in all later sets
    at once; rows of one component are not compared.
    """
    num, den = similarity
    if len(set(labels)) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    by_size = np.argsort(sizes, kind="stable")  # alike sets are of about one size: later rows soon are too large
    nodes, sets, sizes = [nodes[k] for k in by_size], [sets[k] for k in by_size], sizes[by_size]
    kinds, side = np.array(labels)[by_size], np.array(sides)[by_size]
    vocabulary, places = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary), np.int32)
    links, ends = [], np.searchsorted(sizes * num, sizes * den, side="right")
    left = len(np.unique(kinds))
    for i in range(len(nodes) - 1):
        if left == 1:
            break
        later = np.arange(i + 1, ends[i])
        later = later[(kinds[later] != kinds[i]) & (side[later] != side[i] if two else True)]
        if not len(later):
            continue
        own = places[starts[i] : starts[i + 1]]
        mark[own] = 1
        lengths = sizes[later]
        firsts = np.cumsum(lengths) - lengths
        each = np.arange(lengths.sum()) + np.repeat(starts[later] - firsts, lengths)
        common = np.add.reduceat(mark[places[each]], firsts)
        mark[own] = 0
        for j in later[common * den >= (sizes[i] + lengths - common) * num].tolist():
            if kinds[j] != kinds[i]:
                kinds[kinds == max(kinds[i], kinds[j])] = min(kinds[i], kinds[j])
                left -= 1
                links.append((nodes[i], nodes[j]))
    return links


def _block_links(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links ``a, b`` of rows ``family, lo, hi, node, label, side, shingles``, block by block."""
    order = ["family", "lo", "hi"]
    dealt = rows.repartition(*order).sortWithinPartitions(*order, "node").select(*order, "node", "label", "side", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def links() -> pa.RecordBatch:
            nodes, labels, sides, sets = (list(c) for c in zip(*held, strict=True))
            found = links_in_block(nodes, labels, sides, [np.frombuffer(s, np.uint64) for s in sets], similarity, block[1] != block[2])
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for family, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, lo, hi) != block:
                    if len(held) > 1:
                        yield links()
                    block, held = (family, lo, hi), []
                if not held or held[-1][0] != row[0]:  # a set that several tasks found
                    held.append(tuple(row))
        if len(held) > 1:
            yield links()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _links(families: DataFrame, read: DataFrame, words: int, similarity: tuple[int, int], block_rows: int, block_shingles: int) -> DataFrame:
    """Links ``a, b`` that connect all alike nodes; ``families`` has ``node, family, n, set_id, least``."""
    sized = families.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    blocks = F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("size") / block_shingles)).cast("int")
    dealt = salted_join(families, sized.select("family", blocks.alias("blocks")), ["family"], F.col("node"), "inner")
    dealt = stored(dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # the family's smallest node, which names it, is in every block
    everywhere = F.when(F.col("node") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    inside = dealt.select("family", F.explode(everywhere).alias("lo"), "node", "set_id", "least").select("family", "lo", F.col("lo").alias("hi"), "node", F.col("node").alias("label"), F.lit(True).alias("side"), "set_id", "least")
    links = stored(_block_links(_with_sets(inside, read, words), similarity))
    several = dealt.where("blocks > 1")
    if several.isEmpty():
        return links
    labels = components(links).withColumnRenamed("component", "label")
    labelled = stored(several.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    split = labelled.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("family")
    still = salted_join(labelled, split, ["family"], F.col("node"), "inner").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("block <> other")
    across = still.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "label", (F.col("block") < F.col("other")).alias("side"), "set_id", "least")
    return links.unionByName(stored(_block_links(_with_sets(across, read, words), similarity)))


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, set_id``.

    Sets are of distinct runs of ``words`` words, A-Z lower-cased; a text with
    fewer words is one run; a null text and one without words have none, no
    ``set_id``, and are linked with nothing.  Two texts are linked if intersection
    over union of their sets is at least ``similarity``; ``component_id`` is the
    smallest id reachable over links.  Null ids are larger than any, and a component
    of null ids only has none.  Repeated rows and ids are rows of their own; texts of
    any length are read whole; an empty table gives no rows; other columns are not
    read.  Shingles are compared by 64-bit hashes.
    """
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    seen = stored(_sketches(read, words, similarity))
    first = seen.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first(F.struct("keys", "host")).alias("own"))
    nodes = stored(first.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", "own.host", F.posexplode("own.keys").alias("at", "key")).select("key", "node", (F.col("at") < F.col("host")).alias("host"))
    # of the sets that share a signature, one must be of its band: others meet in their own
    shared = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("rows"), F.max("host").alias("hosted")).where("rows > 1 and hosted")
    # as many keys as there are shared signatures: joined by shuffle, where Spark splits a frequent one
    spokes = keyed.join(stored(shared.select("key", "leader")), "key").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    families = components(spokes).withColumnRenamed("component", "family")
    families = stored(families.join(nodes.select("node", "n", "set_id", "least"), "node"))
    labels = components(_links(families, read, words, similarity, block_rows, block_shingles)).withColumnRenamed("node", "_node")
    labelled = stored(nodes.select("set_id", "node", "least").join(labels, F.col("node") == F.col("_node"), "left").select("set_id", "least", "component"))
    linked = labelled.where("component is not null")
    ends = salted_join(linked.select("set_id", "component"), linked.groupBy("component").agg(F.min("least").alias("component_id")), ["component"], F.col("set_id"), "inner")
    ends = ends.select("set_id", "component_id").unionByName(labelled.where("component is null").select("set_id", F.col("least").alias("component_id")))
    # a few numbers a row: Spark splits a set that fills a partition
    found = seen.where("set_id is not null").select("doc_id", "n_shingles", "set_id").join(ends, "set_id").select("doc_id", "n_shingles", "component_id", "set_id")
    alone = seen.where("set_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "set_id")
    return found.unionByName(alone)
