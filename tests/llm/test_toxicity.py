import itertools
import os
import zlib

import numpy as np
import pytest
from awkward_tables import awkward

from rarelabel.llm import crf, toxicity

FOLDER = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    r = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 5):
        evidence, stay, enter = r.normal(size=n), 0.7, -0.4
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            s = sum(e for e, y in zip(evidence, path, strict=True) if y)
            s += sum((stay if a else enter) for a, b in itertools.pairwise(path) if b)
            weight[path] = np.exp(s)
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[k]) / total for k in range(n)]
        table = np.zeros((crf.CHAIN, 1))
        table[:n, 0] = evidence
        odds, stayed, entered = crf.marginals(table, np.array([n]), stay, enter)
        assert crf.sigmoid(odds[:n, 0]) == pytest.approx(want)
        assert stayed == pytest.approx(sum(w * sum(a and b for a, b in itertools.pairwise(p)) for p, w in weight.items()) / total)
        assert entered == pytest.approx(sum(w * sum(b and not a for a, b in itertools.pairwise(p)) for p, w in weight.items()) / total)


def test_chains_hold_every_word_once():
    sizes = np.array([0, 3, 64, 65, 0, 200])
    values = np.arange(sizes.sum(), dtype=float)
    table, place, chain = crf.chains(values, sizes)
    assert (table[place, chain] == values).all() and table.shape == (crf.CHAIN, 1 + 1 + 2 + 4)


def made_up(n=300):
    r = np.random.Generator(np.random.PCG64(3))
    words = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        w = list(r.choice(words, 40))
        if toxic:
            for _ in range(3):
                w[r.integers(40)] = r.choice(["Vile,", "grubstem" + r.choice(["a", "en", "ung"])])
        docs.append((i, " ".join(w), "a"))
        labels.append((i, 1, toxic))
    return docs, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_learned_words_and_spans(docs, spark):
    rows, labels = made_up()
    table = docs(rows)
    extra = [(None, 1, 1), (4, 1, None), (0, 0, 1), (0, 0, 0), (10**9, 1, 1)]
    found = {r.doc_id: r for r in toxicity.toxicity(table, table, spark.createDataFrame(labels + extra, LABELS)).collect()}
    texts = {i: t for i, t, _ in rows}
    assert len(found) == len(rows)
    for i, _, toxic in labels:
        assert found[i].predicted == toxic == int(found[i].score >= 0.7)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        tagged = {texts[i][s.start : s.start + s.length] for s in found[i].spans}
        assert bool(tagged) == bool(toxic)
        assert all(w.startswith(("Vile", "grubstem")) for t in tagged for w in t.split())


def test_awkward_rows_get_scores(docs, spark):
    rows = awkward(8)
    model = toxicity.fit([(t, y, 10) for (_, t, _), (_, _, y) in zip(*made_up(), strict=True)])
    found = toxicity.score(docs(rows), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if r.doc_id is None and not r.spans}
    assert len({r.score for r in toxicity.score(docs([(1, None, "a"), (2, "", "b"), (3, " \n", None)]), model).collect()} | empty) <= 2
    assert toxicity.score(docs([]), model).collect() == []


@pytest.mark.parametrize("labels", [[], [(0, 1, 1)], [(0, 1, 0), (2, 1, 0)]])
def test_labels_of_one_kind(docs, spark, labels):
    table = docs(made_up(20)[0])
    scores = {r.score for r in toxicity.toxicity(table, table, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(scores) == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    hit = sum(r.predicted and r.toxic for r in found)
    precision, recall = hit / sum(r.predicted for r in found), hit / sum(r.toxic for r in found)
    assert precision > 0.95 and recall > 0.9, (precision, recall, len(found))


def test_repeated_ids_give_one_model_however_rows_are_dealt(spark):
    rows = [(i % 7, f"word{i} " * 5 + ("scum" if i % 7 < 3 else "fine")) for i in range(280)]
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "doc_id bigint, toxic int")
    found = {str(toxicity.sample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n), labels)) for n in (1, 3, 5, 8)}
    assert len(found) == 1


def test_clean_texts_of_the_chain_are_a_parameter():
    rows = [(f"you scum number{i}", 1, 40) for i in range(40)] + [(f"good day number{i} friend", 0, 60) for i in range(60)]
    few, many = (toxicity.fit(rows, n) for n in (5, 60))
    assert few.own != many.own and few.score(few.word_odds([["scum"]])[0]) > few.score(few.word_odds([["friend"]])[0])
