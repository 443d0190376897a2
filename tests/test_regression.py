import numpy as np
import pytest
from comparing import rows
from pyspark.sql import functions as F

from rarelabel.functions.features import Features
from rarelabel.operators import regression
from rarelabel.operators.encode import assemble
from rarelabel.operators.split import with_cell
from rarelabel.plans import learners, regressions

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Not separable; ``b`` is large with a small spread, ``c`` never varies."""
    i = F.col("id")
    noise = F.pmod(F.xxhash64(i, F.lit(5)), F.lit(100))
    df = spark.range(900).select(
        "id", (F.pmod(F.xxhash64(i), F.lit(50)) / 7.0).alias("a"), (F.pmod(F.xxhash64(i, F.lit(2)), F.lit(9)) + 1e6).alias("b"), F.lit(3.0).alias("c")
    )
    return df.withColumn("label", (F.col("a") * 10 + (F.col("b") - 1e6) * 3 + noise > 90).cast("double")).cache()


def fitted(table, penalty, trained=None, cells=4):
    ready = regression.labelled_cells(with_cell(table, "id", cells, 3, "_cell"), Features.columns(NAMES), "label", "_cell", ["id"])
    return regression.fit_many(ready, 3, np.ones((cells, 1), bool) if trained is None else trained, penalty), ready


@pytest.mark.parametrize("penalty", [0.01, 1.0])
def test_equals_the_library(table, penalty):
    fits, _ = fitted(table, [penalty])
    model = learners.logistic_regression(regParam=penalty, tol=1e-14, maxIter=2000).fit(assemble(table, NAMES))
    spread = np.array(table.agg(*[F.stddev_samp(n) for n in NAMES]).first())
    assert fits.settled.all()
    assert np.abs((fits.weights[0, 1:] - np.array(model.coefficients)) * spread).max() < 1e-6
    assert fits.weights[0, 3] == 0.0
    centre = np.array(table.agg(*[F.avg(n) for n in NAMES]).first())
    assert fits.weights[0, 0] + fits.weights[0, 1:] @ centre == pytest.approx(model.intercept + np.array(model.coefficients) @ centre, abs=1e-6)


def test_cells_give_the_fits_of_their_rows(table):
    trained = np.array([[1, 0, 1, 1], [1, 1, 0, 1], [0, 1, 1, 1], [1, 1, 1, 0]], bool)
    penalty = [0.1, 1.0, 0.1, 0.5]
    fits, ready = fitted(table, penalty, trained)
    for m in range(4):
        kept = ready.where(F.col("cell").isin([int(c) for c in np.flatnonzero(trained[:, m])]))
        alone = regression.fit_many(kept, 3, np.ones((4, 1), bool), [penalty[m]])
        assert np.allclose(alone.weights[0], fits.weights[m], rtol=1e-7, atol=1e-9)


def test_optimum_has_no_slope(table):
    """Observed sums equal expected ones plus the pull of the penalty."""
    fits, _ = fitted(table, [0.3])
    got = np.array([tuple(r) for r in table.select(*NAMES, "label").collect()])
    x, y = got[:, :3], got[:, 3]
    p = 1 / (1 + np.exp(-(fits.weights[0, 0] + x @ fits.weights[0, 1:])))
    scale = x.std(axis=0, ddof=1)
    pull = 0.3 * len(y) * scale**2 * fits.weights[0, 1:]
    assert np.abs(((x - x.mean(axis=0)) * (y - p)[:, None]).sum(axis=0) - pull).max() < 1e-6
    assert abs((y - p).sum()) < 1e-6


def test_one_class_no_rows_and_separable_classes(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("a"), (F.col("id") >= 20).cast("double").alias("label"), (F.col("id") >= 20).cast("int").alias("cell"))
    ready = regression.labelled_cells(df, Features.columns(["a"]), "label", "cell")
    trained = np.array([[1, 0, 0, 1, 1], [0, 1, 0, 1, 1]], bool)
    fits = regression.fit_many(ready, 1, trained, [1.0, 1.0, 1.0, 1.0, 0.0])
    assert fits.weights[0, 0] == -np.inf and fits.weights[1, 0] == np.inf and np.isnan(fits.weights[2, 0])
    assert fits.settled[3] and not fits.settled[4]
    scored = regression.score_many(ready, 1, fits.weights, trained)
    assert rows(scored.where("model < 2").select("model", "score").distinct()) == [(0, 0.0), (1, 1.0)]


def test_bad_rows_are_errors(spark):
    for value in ("cast(2 as double)", "cast(null as double)"):
        df = spark.range(3).selectExpr("id", f"{value} AS label", "0 AS cell", "1.0 AS a")
        with pytest.raises(Exception, match="neither 0 nor 1"):
            regression.labelled_cells(df, Features.columns(["a"]), "label", "cell").collect()
    with pytest.raises(Exception, match="feature is null"):
        df = spark.range(3).selectExpr("id", "1.0 AS label", "0 AS cell", "cast(null as double) AS a")
        regression.labelled_cells(df, Features.columns(["a"]), "label", "cell").collect()


def test_scores_are_of_the_models_that_hold_a_row_out(table):
    fits, ready = fitted(table, [1.0, 1.0], np.array([[1, 0], [1, 1], [0, 1], [1, 1]], bool))
    judged = np.array([[0, 1], [0, 0], [1, 0], [0, 0]], bool)
    scored = regression.score_many(ready, 3, fits.weights, judged, ["id"])
    assert rows(scored.join(ready.select("id", "cell"), "id").select("cell", "model").distinct()) == [(0, 1), (2, 0)]
    assert scored.count() == ready.where("cell in (0, 2)").count()


def test_rounds_do_not_depend_on_other_rounds(table):
    few, many = (regressions.regression_rounds(table, Features.columns(NAMES), "label", "id", n, 5, cells=32) for n in (3, 6))
    assert [pytest.approx(r) for r in rows(few)] == rows(many.where("round < 3"))


def test_nested_plan_picks_by_training_rows_only(table):
    found = regressions.regression_nested(table, Features.columns(NAMES), "label", "id", 2, 3, 5, [0.01, 1.0], cells=32).collect()
    held, dealt = regressions.drawn_cells(table.sparkSession, 2, 32, 0.2, 5, 3)
    assert len(found) == 2 and held.any(axis=0).all() and set(dealt.ravel()) == {0, 1, 2}
    celled = with_cell(table, "id", 32, 5)
    for r in found:
        train = celled.where(F.col("cell").isin([int(c) for c in np.flatnonzero(~held[:, r["round"]])]))
        folds = F.element_at(F.array(*[F.lit(int(f)) for f in dealt[:, r["round"]]]), F.col("cell") + 1)
        from pyspark.ml.evaluation import BinaryClassificationEvaluator

        from rarelabel.plans.tuning import cross_validate, param_grid

        lr = learners.logistic_regression(tol=1e-12, maxIter=500)
        ready = assemble(train.withColumn("fold", folds), NAMES, keep=["fold"])
        results = cross_validate(ready, lr, BinaryClassificationEvaluator(numBins=0), param_grid({lr.regParam: [0.01, 1.0]}), 3)
        means = {x.params: x.m for x in results.groupBy("params").agg(F.avg("metric").alias("m")).collect()}
        assert max(means.values()) == pytest.approx(r.cv_roc_auc, abs=1e-6)


def test_a_step_is_one_job(spark, table):
    """Ten times the models take no more jobs."""
    counts = []
    for models in (1, 10):
        spark.sparkContext.setJobGroup(f"fit-{models}", "")
        fitted(table, [1.0] * models, np.ones((4, models), bool))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{models}")))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert counts[0] == counts[1]
