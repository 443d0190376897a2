import collections
import hashlib

import pytest
from awkward_tables import awkward
from pyspark.sql import functions as F

from rarelabel.llm import exact_dedup
from rarelabel.llm.common import ascii_lower


def lower(t):
    return (t or "").encode().lower().decode()


def expected(rows):
    groups = collections.defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted((str(i), str(best[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in rows)


@pytest.mark.parametrize("segment_bytes", [4096, exact_dedup.SEGMENT_BYTES])
def test_groups_equal_brute_force(docs, segment_bytes):
    rows = awkward()
    found = exact_dedup.duplicate_groups(docs(rows), segment_bytes=segment_bytes).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected(rows)
    kept = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})


def test_dedup_keeps_columns_and_one_row_of_each_text(docs):
    rows = awkward(1)
    table = docs(rows)
    kept = exact_dedup.exact_dedup(table)
    assert kept.columns == table.columns
    texts = [lower(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t, _ in rows})


def test_filter_has_several_segments_and_no_false_negative(spark):
    rows = spark.range(50_000).select(F.col("id"), F.sha2((F.col("id") % 40_000).cast("string"), 256).alias("k")).checkpoint()
    tested = exact_dedup.possibly_repeated(rows, "k", segment_bytes=8192)
    marked = tested.groupBy((F.col("id") % 40_000 < 10_000).alias("twice")).agg(F.count("*").alias("n"), F.count_if("maybe").alias("maybe")).collect()
    by = {r.twice: r for r in marked}
    assert by[True].n == by[True].maybe == 20_000
    assert by[False].n == 30_000 and by[False].maybe < 0.05 * by[False].n


def test_empty_table(docs):
    assert exact_dedup.duplicate_groups(docs([])).collect() == []
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_only_ascii_letters_change(spark):
    texts = ["ABZaz[@`{É Ω", "PLAIN", "İI", ""]
    got = [r.l for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t")).alias("l")).collect()]
    assert got == [lower(t) for t in texts]
