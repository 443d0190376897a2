import numpy as np
import pytest
from comparing import rows
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from rarelabel.functions.features import Features
from rarelabel.operators import naive_bayes as nb
from rarelabel.operators.encode import assemble
from rarelabel.operators.split import cell_is_test, with_cell, with_fold
from rarelabel.plans.holdout import naive_bayes_folds, naive_bayes_rounds

FEATURES = Features.columns(["a", "b", "c"])


@pytest.fixture(scope="module")
def table(spark):
    i = F.col("id")
    return spark.range(400).select(
        "id",
        (i * i % 7 % 3).cast("double").alias("label"),
        (i % 5).cast("double").alias("a"),
        ((i * 13) % 4).cast("double").alias("b"),
        ((i * i) % 6).cast("double").alias("c"),
    )


def test_weights_and_predictions_match_the_library(table):
    vectors = assemble(table, FEATURES.names, keep=["id"])
    library = NaiveBayes(modelType="multinomial", smoothing=0.7).fit(vectors)
    model = nb.fit(table, FEATURES, smoothing=0.7)
    got = {r.label: (r.pi, list(r.theta)) for r in model.collect()}
    for c in range(3):
        assert abs(got[float(c)][0] - library.pi[c]) < 1e-9
        assert np.allclose(got[float(c)][1], library.theta.toArray()[c])
    ours = nb.score(table, model, FEATURES, [0.0, 1.0, 2.0], keep=["id"], probability_of=1.0)
    theirs = {r.id: r for r in library.transform(vectors).collect()}
    for r in ours.collect():
        assert r.prediction == theirs[r.id].prediction
        assert abs(r.probability - theirs[r.id].probability[1]) < 1e-9


def test_vector_input_gives_the_same_model(table):
    vectors = assemble(table, FEATURES.names)
    a = rows(nb.weights(nb.fit(table, FEATURES)), "label", "pos", "theta")
    b = rows(nb.weights(nb.fit(vectors, Features.of_vector("features", 3))), "label", "pos", "theta")
    assert np.allclose(np.array(a), np.array(b))


def test_negative_features_are_refused(table):
    with pytest.raises(Exception, match="not negative"):
        nb.fit(table.withColumn("a", -F.col("a")), FEATURES).collect()


def test_groups_are_fitted_apart(table):
    grouped = table.withColumn("g", (F.col("id") % 2).cast("int"))
    both = nb.fit(grouped, FEATURES, by=["g"])
    alone = nb.fit(grouped.filter("g = 1"), FEATURES)
    assert rows(nb.weights(both.filter("g = 1")), "label", "pos", "theta") == rows(nb.weights(alone), "label", "pos", "theta")


def test_absent_class_is_not_predicted(table):
    model = nb.fit(table.filter("label < 2"), FEATURES)
    out = nb.score(table, model, FEATURES, [0.0, 1.0, 2.0], keep=["id"])
    assert out.filter("prediction = 2").count() == 0 and out.count() == 400


def test_ties_go_to_the_lowest_class(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "label double, a double")
    one = Features.columns(["a"])
    out = nb.score(df, nb.fit(df, one), one, [0.0, 1.0], keep=["label"])
    assert rows(out, "prediction") == [(0.0,), (0.0,)]


def test_rounds_equal_one_fit_per_round(table):
    cells, seed, rounds = 32, 3, 4
    got = naive_bayes_rounds(table, FEATURES, "label", "id", rounds, seed, cells=cells)
    got = rows(got.groupBy("round", "label", "prediction").count())
    want = []
    celled = with_cell(table, "id", cells, seed)
    for r in range(rounds):
        held = cell_is_test("cell", F.lit(r), 0.2, seed)
        model = nb.fit(celled.filter(~held), FEATURES)
        out = nb.score(celled.filter(held), model, FEATURES, [0.0, 1.0, 2.0], keep=["label"])
        want += [(r, *t) for t in rows(out.groupBy("label", "prediction").count())]
    assert got == sorted(want)


def test_folds_equal_one_fit_per_fold(table):
    got = naive_bayes_folds(table, FEATURES, "label", "id", 3, 5, (0.1, 1.0))
    got = rows(got.groupBy("smoothing", "fold", "label", "prediction").count())
    want = []
    folded = with_fold(table, "id", 3, 5)
    for lam in (0.1, 1.0):
        for k in range(3):
            model = nb.fit(folded.filter(F.col("fold") != k), FEATURES, smoothing=lam)
            out = nb.score(folded.filter(F.col("fold") == k), model, FEATURES, [0.0, 1.0, 2.0], keep=["label"])
            want += [(lam, k, *t) for t in rows(out.groupBy("label", "prediction").count())]
    assert got == sorted(want)


def test_wide_models_take_the_array_form(table, monkeypatch):
    model = nb.fit(table.filter("label < 2"), FEATURES)
    written = nb.score(table, model, FEATURES, [0.0, 1.0, 2.0], keep=["id"], probability_of=1.0)
    before = rows(written)
    monkeypatch.setattr(nb, "MAX_TERMS", 1)
    looped = nb.score(table, model, FEATURES, [0.0, 1.0, 2.0], keep=["id"], probability_of=1.0)
    for a, b in zip(before, rows(looped)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-12
    absent = nb.score(table, model, FEATURES, [0.0, 1.0, 2.0], keep=["id"], probability_of=2.0)
    assert rows(absent.select("probability").distinct()) == [(0.0,)]


def test_large_models_are_sent_in_shares(table, monkeypatch):
    def run():
        out = naive_bayes_rounds(table, FEATURES, "label", "id", 6, 3, cells=32)
        return rows(out.groupBy("round", "label", "prediction").count())

    before = run()
    for limit in (2 * 3 * 4 * 8, 1):
        monkeypatch.setattr(nb, "MODEL_BYTES", limit)
        assert run() == before
