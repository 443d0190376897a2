"""Stages against brute force on small driver tables."""

import collections
import os

import pytest

import corpus_pipeline
from awkward_tables import awkward
from rarelabel.llm import mixing, toxicity
from test_minhash import brute, shingles

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(docs)
    return seen


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(stages, spark):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(stages[0], stages[0], labels).collect()}
    assert kept == {i for i, p in predicted.items() if not p} and sum(predicted.values())
    insults = {"trash", "pathetic", "idiot", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    for r in stages[0].where("lang = 'en'").collect():
        if not any(w.strip(".,!?;:*#$%&").lower() in insults for w in r.text.split()):
            assert r.doc_id in kept


def test_copies(stages):
    best = {}
    for r in stages[1].collect():
        key = r.text.encode().lower()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(best.values()) == sorted(r.doc_id for r in stages[2].collect())


def test_near_copies(stages):
    rows = [(r.doc_id, shingles(r.text, 5)) for r in stages[2].orderBy("doc_id").collect()]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert sorted({find(i) for i, _ in rows}) == sorted(r.doc_id for r in stages[3].collect())


def test_mix_takes_whole_documents(stages):
    want = collections.Counter({r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()})
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == +want


def test_packed_pieces(stages, spark):
    pieces = stages[5].collect()
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(r.doc_id for r in stages[4].collect())
    assert corpus_pipeline.run(spark, FOLDER).count() == len(pieces)


@pytest.fixture
def labelled(spark, tmp_path):
    """A folder with labels of which no text is toxic."""
    spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_awkward_rows_pass_all_stages(spark, docs, labelled):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing column names: each stage by its own rule."""
    rows = awkward(11)
    table = docs(rows)
    plain = lambda df: collections.Counter((r.doc_id, r.text, r.source) for r in df.collect())
    kept = corpus_pipeline.drop_toxic(spark, table, labelled)
    assert kept.columns == table.columns and plain(kept) == collections.Counter(rows)
    single = corpus_pipeline.drop_copies(spark, table, labelled)
    best = {}
    for i, t, _ in rows:
        key = (t or "").encode().lower()
        best[key] = max(best.get(key, (False, 0)), (i is not None, i or 0))
    assert collections.Counter(((r.text or "").encode().lower(), (r.doc_id is not None, r.doc_id or 0)) for r in single.collect()) == collections.Counter(best.items())
    near = corpus_pipeline.drop_near_copies(spark, table, labelled)
    found, n = brute(rows, 5)
    assert near.count() == n and {r.doc_id for r in near.collect()} <= {c for _, _, c in found}
    mixed = corpus_pipeline.mix_sources(spark, table, labelled)
    assert mixed.columns == single.columns == near.columns == table.columns and set(plain(mixed)) <= set(rows)
    pieces = corpus_pipeline.pack_sequences(spark, table, labelled).collect()
    assert collections.Counter(r.doc_id for r in pieces if r.piece == 0) == collections.Counter(i for i, _, _ in rows)
    ends = collections.defaultdict(int)
    for r in pieces:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048


def test_empty_tables_pass_all_stages(spark, docs, labelled):
    table = docs([(1, "a", "a")]).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, labelled).count() == 0
