"""Row numbers hold when a table is split anew between two scans, as it is when executors come or go."""

import pytest

import corpus_pipeline
from rarelabel.llm import exact_dedup, minhash, mixing, toxicity
from rarelabel.llm.common import stored

PARTS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def split_anew(spark, monkeypatch):
    """Make a function's result stored under one split of the input, with later scans under another."""

    def make(module, name):
        plain = getattr(module, name)

        def wrapped(*args, **options):
            found = stored(plain(*args, **options))
            spark.conf.set(PARTS, "16")
            return found

        monkeypatch.setattr(module, name, wrapped)

    spark.conf.set(PARTS, "1")
    yield make
    spark.conf.unset(PARTS)


def pairs(docs):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    return docs([(i, text(i // 2), "a") for i in range(60)])


def test_near_copies(docs, split_anew):
    split_anew(minhash, "near_duplicates")
    assert sorted(r.doc_id for r in minhash.near_dedup(pairs(docs)).collect()) == list(range(0, 60, 2))


def test_texts_alike_in_second_scan(docs, split_anew):
    split_anew(minhash, "sketches")
    text = lambda i: " ".join(f"w{i // 2}x{k}" for k in range(60)) + f" end{i}"
    found = minhash.near_duplicates(docs([(i, text(i), "a") for i in range(60)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i - i % 2) for i in range(60)]


def test_exact_copies(docs, split_anew):
    split_anew(exact_dedup, "duplicate_groups")
    assert sorted(r.doc_id for r in exact_dedup.exact_dedup(pairs(docs)).collect()) == list(range(1, 60, 2))


def test_mix(docs, split_anew):
    table = docs([(i, "word " * (1 + i % 7), "ab"[i % 2]) for i in range(60)])
    want = {r.doc_id: r.copies for r in mixing.mix(table).collect() if r.copies}
    split_anew(mixing, "mix")
    got = [r.doc_id for r in mixing.mixed(table).collect()]
    assert {i: got.count(i) for i in got} == want and set(want.values()) != {1}


def test_toxic(docs, spark, split_anew, monkeypatch, tmp_path):
    table = docs([(i, "bad" if i % 3 == 0 else "good", "a") for i in range(60)])
    spark.createDataFrame([(0, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = lambda d, _, labels, *number: toxicity.score(d, toxicity.fit([]), "doc_id", "text", *number).selectExpr("row", "int(doc_id % 3 = 0) AS predicted")
    monkeypatch.setattr(toxicity, "toxicity", scored)
    split_anew(toxicity, "toxicity")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, table, str(tmp_path)).collect()) == [i for i in range(60) if i % 3]
