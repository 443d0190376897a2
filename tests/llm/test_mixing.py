import collections
import re

import pytest
from awkward_tables import awkward

from rarelabel.llm import mixing


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(rows):
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(3 * sizes[s] for s in held)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in held else weight[s] * level for s in names}, sizes
        held |= over


def test_targets_and_copies(docs):
    rows = awkward(2)
    found = mixing.mix(docs(rows)).collect()
    want, sizes = targets(rows)
    assert len(found) == len(rows)
    taken, longest = collections.Counter(), collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * longest[s]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_and_rows_come_out_as_often_as_taken(docs):
    rows = awkward(3)
    table = docs(rows)
    once, again = (sorted(map(str, mixing.mix(table).collect())) for _ in range(2))
    assert once == again
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    copies = collections.Counter()
    for r in mixing.mix(table).collect():
        copies[r.doc_id] += r.copies
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +copies


def test_sources_without_words_and_empty_table(docs):
    found = mixing.mix(docs([(1, None, "a"), (2, "", "b"), (3, "x y", "c")])).collect()
    assert {r.source: r.target for r in found} == {"a": 0.0, "b": 0.0, "c": 2.0}
    assert {r.doc_id: r.taken for r in found} == {1: 0, 2: 0, 3: 2}
    assert mixing.mix(docs([])).collect() == []
    assert mixing.mix(docs([(1, None, None)])).collect()[0].taken == 0


def test_words_taken_come_near_the_target_on_a_large_source(spark):
    from pyspark.sql import functions as F

    table = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text")
    ).checkpoint()
    by = mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 97 for r in by)
