import numpy as np
import pytest
from comparing import rows
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from rarelabel.functions.features import Features
from rarelabel.functions.probability import chi_square_tail
from rarelabel.operators import chisq, pca
from rarelabel.operators.encode import assemble


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(600).select(
        (F.col("id") % 3).cast("double").alias("label"),
        (F.col("id") % 2).cast("double").alias("a"),
        ((F.col("id") % 3 + F.col("id") % 7) % 4).cast("double").alias("b"),
        (F.col("id") * 31 % 17).cast("double").alias("c"),
    )


FEATURES = Features.columns(["a", "b", "c"])


def test_scores_match_the_library(table):
    vectors = assemble(table, FEATURES.names)
    want = sorted(
        (r.featureIndex, r.statistic, r.degreesOfFreedom, r.pValue)
        for r in ChiSquareTest.test(vectors, "features", "label", True).collect()
    )
    for df, features in ((table, FEATURES), (vectors, Features.of_vector("features", 3))):
        got = rows(chisq.with_p_value(chisq.chi_square_scores(df, features)), "pos", "statistic", "degrees", "p_value")
        assert np.allclose(np.array(got), np.array(want), rtol=1e-9, atol=1e-9)


def test_classes_joined_by_shuffle_give_the_same(table, monkeypatch):
    before = rows(chisq.chi_square_scores(table, FEATURES), "pos", "statistic", "degrees")
    monkeypatch.setattr(chisq, "BROADCAST_CLASSES", 0)
    after = rows(chisq.chi_square_scores(table, FEATURES), "pos", "statistic", "degrees")
    assert np.allclose(np.array(before), np.array(after), rtol=1e-9, atol=1e-8)


def test_renaming_values_does_not_matter(table):
    renamed = table.withColumn("b", 100 - 7 * F.col("b"))
    a = rows(chisq.chi_square_scores(table, FEATURES), "pos", "statistic")
    b = rows(chisq.chi_square_scores(renamed, FEATURES), "pos", "statistic")
    assert np.allclose(np.array(a), np.array(b))


def test_ranking_by_statistic_and_by_p_value(spark):
    scores = spark.createDataFrame(
        [(0, "x", 9.0, 1, 0.1), (1, "y", 12.0, 30, 0.1), (2, "z", 9.0, 1, 0.1)],
        "pos int, name string, statistic double, degrees bigint, value_share double",
    )
    assert rows(chisq.rank_features(scores), "rank", "pos") == [(1, 1), (2, 0), (3, 2)]
    assert rows(chisq.rank_features(scores, "p_value"), "rank", "pos") == [(1, 0), (2, 2), (3, 1)]
    assert chisq.selected_positions(chisq.rank_features(scores), 2) == [0, 1]
    with pytest.raises(ValueError):
        chisq.rank_features(scores, "name")


def test_projection_of_columns_and_vectors(table):
    assert chisq.project(table, FEATURES, [0, 2], ["label"]).columns == ["label", "a", "c"]
    vectors = assemble(table, FEATURES.names)
    cut = chisq.project(vectors, Features.of_vector("features", 3), [0, 2], ["label"]).first()
    assert len(cut.features) == 2


def test_sweep_uses_one_ranking(spark, table):
    ranked = chisq.rank_features(chisq.chi_square_scores(table, FEATURES))
    assert rows(chisq.sweep(ranked, [1, 3]).groupBy("k").count()) == [(1, 1), (3, 3)]
    assert chisq.sweep_sizes(36) == [5, 9, 14, 18, 23, 27, 32]


@pytest.mark.parametrize("x, k, p", [(3.841459, 1, 0.05), (18.307038, 10, 0.05), (124.342113, 100, 0.05), (0.0, 3, 1.0)])
def test_chi_square_tail(x, k, p):
    assert abs(chi_square_tail(x, k) - p) < 1e-6


def test_covariance_and_projection(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) + 5
    x[:, 3] = 2.0
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double, d double")
    vectors = assemble(df.withColumn("label", F.lit(0)), ["a", "b", "c", "d"], keep=["id"])
    want = np.cov(x.T)
    for i, j, c in rows(pca.covariance(vectors)):
        assert abs(c - want[i, j]) < 1e-9
    model = pca.fit_pca(vectors, 2)
    values, axes = np.linalg.eigh(want)
    axes = axes[:, ::-1][:, :2]
    for center, data in ((False, x), (True, x - x.mean(axis=0))):
        got = np.array([r.features.toArray() for r in pca.pca_project(vectors, model, center=center).orderBy("id").collect()])
        assert np.allclose(np.abs(got), np.abs(data @ axes), atol=1e-8)
    assert pca.component_table(vectors, model).count() == 8


def test_chi_square_of_very_many_classes(spark):
    """Fifty thousand classes, most cells empty, against the sums written out."""
    df = spark.range(120_000).select((F.col("id") % 50_000).alias("label"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 50_000 % 2).cast("double").alias("b"))
    found = {r.name: r for r in chisq.chi_square_scores(df, Features.columns(["a", "b"])).collect()}
    i = np.arange(120_000)
    for name, value in (("a", i % 7), ("b", i % 50_000 % 2)):
        seen = np.zeros((value.max() + 1, 50_000))
        np.add.at(seen, (value, i % 50_000), 1)
        fit = np.outer(seen.sum(axis=1), seen.sum(axis=0)) / len(i)
        assert found[name].statistic == pytest.approx(((seen - fit) ** 2 / fit).sum(), rel=1e-9)
        assert found[name].degrees == value.max() * 49_999


def test_identifiers_are_warned_of(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("label"), F.col("id").cast("double").alias("key"), (F.col("id") % 3).cast("double").alias("a"))
    with pytest.warns(UserWarning, match="key"):
        assert chisq.warn_of_identifiers(chisq.chi_square_scores(df, Features.columns(["key", "a"]))) == ["key"]


def test_covariance_is_the_same_in_any_blocks(spark):
    from pyspark.ml.functions import array_to_vector

    i = F.col("id")
    df = spark.range(300).repartition(3).select(array_to_vector(F.array(*[(F.pmod(F.xxhash64(i, F.lit(k)), F.lit(1000)) + 1e7 * k).cast("double") for k in range(7)], F.lit(2.0))).alias("features"))
    x = np.array([r.features.toArray() for r in df.collect()])
    want = np.cov(x.T)
    for block in (1, 3, 128):
        found = pca.covariance(df, block=block).collect()
        assert len(found) == 36
        assert all(r["cov"] == pytest.approx(want[r.i, r.j], rel=1e-9, abs=1e-6) for r in found)
    assert pca.covariance(df.where("false")).collect() == []
    assert {r["cov"] for r in pca.covariance(df.limit(1)).collect()} == {None}


def test_components_solve_the_covariance(spark):
    from pyspark.ml.functions import array_to_vector

    i = F.col("id")
    df = spark.range(200).select(array_to_vector(F.array(*[F.pmod(F.xxhash64(i, F.lit(k)), F.lit(50 * (k + 1))).cast("double") for k in range(5)])).alias("features"))
    found = pca.spectrum(df, pca.fit_pca(df, 5)).orderBy("component").collect()
    assert [r.eigenvalue for r in found] == sorted((r.eigenvalue for r in found), reverse=True)
    assert max(r.residual for r in found) < 1e-6 and all(abs(r.length - 1) < 1e-9 for r in found)
