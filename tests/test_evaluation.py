import pytest
from comparing import rows
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from rarelabel.operators import confusion as cm
from rarelabel.operators import curves
from rarelabel.plans.report import evaluation_report, write_report


@pytest.fixture(scope="module")
def predictions(spark):
    i = F.col("id")
    return spark.range(500).select(
        (i % 3).cast("double").alias("label"),
        F.when(i % 5 == 0, (i + 1) % 3).otherwise(i % 3).cast("double").alias("prediction"),
        (i * 37 % 41 + (i % 3) * 5).cast("double").alias("score"),
        (i % 2).cast("int").alias("round"),
    )


def test_hand_worked_case(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0)], "label double, prediction double")
    totals = cm.class_totals(cm.confusion(df))
    assert rows(totals) == [(0.0, 1, 1, 1, 2), (1.0, 2, 1, 0, 2), (2.0, 0, 0, 1, 4)]
    metrics = {r.label: r for r in cm.class_metrics(totals).collect()}
    assert (metrics[0.0].precision, metrics[0.0].recall, metrics[0.0].f1) == (0.5, 0.5, 0.5)
    assert metrics[1.0].precision == pytest.approx(2 / 3) and metrics[1.0].fpr == pytest.approx(1 / 3)
    assert (metrics[2.0].precision, metrics[2.0].recall, metrics[2.0].f1) == (0.0, 0.0, 0.0)
    overall = cm.overall_metrics(totals).first()
    assert overall.accuracy == overall.micro_f1 == pytest.approx(0.6) and overall.rows == 5


def test_metrics_match_the_library(predictions):
    totals = cm.class_totals(cm.confusion(predictions))
    overall = cm.overall_metrics(totals).first().asDict()
    names = {"accuracy": "accuracy", "weighted_f1": "f1", "weighted_precision": "weightedPrecision",
             "weighted_recall": "weightedRecall", "weighted_fpr": "weightedFalsePositiveRate"}
    for ours, theirs in names.items():
        assert overall[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(predictions))
    for r in cm.class_metrics(totals).collect():
        for ours, theirs in (("precision", "precisionByLabel"), ("recall", "recallByLabel"), ("f1", "fMeasureByLabel"), ("fpr", "falsePositiveRateByLabel")):
            want = MulticlassClassificationEvaluator(metricName=theirs, metricLabel=r.label).evaluate(predictions)
            assert r[ours] == pytest.approx(want)


def test_groups_are_evaluated_apart(predictions):
    by = ["round"]
    together = cm.overall_metrics(cm.class_totals(cm.confusion(predictions, by), by), by)
    for r in (0, 1):
        alone = cm.overall_metrics(cm.class_totals(cm.confusion(predictions.filter(F.col("round") == r)))).first()
        assert together.filter(F.col("round") == r).first().accuracy == alone.accuracy


def test_absent_class_is_listed_in_every_group(spark, predictions):
    domain = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,)], "label double")
    totals = cm.class_totals(cm.confusion(predictions, ["round"]), ["round"], domain)
    ghost = cm.class_metrics(totals, ["round"]).filter("label = 3")
    assert rows(ghost, "round", "precision", "f1", "fpr", "support") == [(0, 0.0, 0.0, 0.0, 0), (1, 0.0, 0.0, 0.0, 0)]
    assert ghost.filter("recall is not null").count() == 0


@pytest.fixture(params=["1", "8", "100"])
def partitions(spark, request):
    """Sorted tables in so many partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_areas_match_the_library_for_any_partitions(predictions, partitions):
    binary = predictions.withColumn("label", (F.col("label") == 1).cast("double"))
    areas = curves.binary_areas(binary, "score", positive=1.0).first()
    for ours, theirs in (("roc_auc", "areaUnderROC"), ("pr_auc", "areaUnderPR")):
        want = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=theirs, numBins=0).evaluate(binary)
        assert areas[ours] == pytest.approx(want, abs=1e-12)


def test_grouped_areas(predictions, partitions):
    got = curves.binary_areas(predictions, "score", "label", 1.0, ["round"])
    for r in (0, 1):
        alone = curves.binary_areas(predictions.filter(F.col("round") == r), "score", "label", 1.0).first()
        assert got.filter(F.col("round") == r).first().roc_auc == pytest.approx(alone.roc_auc)


def test_scores_are_sorted_once_and_spread(spark, predictions, partitions):
    """One group's scores lie in order over several partitions; no partition holds them all."""
    placed = curves.sorted_by_score(curves.score_counts(predictions, "score", F.col("label") == 1.0), [])
    ranges = placed.groupBy("_part").agg(F.min("score").alias("low"), F.max("score").alias("high")).orderBy("_part").collect()
    assert (len(ranges) > 1) == (partitions > 1)
    assert all(a.low > b.high for a, b in zip(ranges, ranges[1:]))


def test_one_vs_rest_by_group(predictions, partitions):
    classes = [0.0, 1.0, 2.0]
    got = {(r["round"], r.label): (r.roc_auc, r.pr_auc) for r in curves.one_vs_rest_areas(predictions, "score", "label", classes, ["round"]).collect()}
    assert len(got) == 6
    for r in (0, 1):
        for x in curves.one_vs_rest_areas(predictions.filter(F.col("round") == r), "score", "label", classes).collect():
            assert got[r, x.label] == pytest.approx((x.roc_auc, x.pr_auc))
    macro = {r["round"]: r.roc_auc for r in curves.macro_areas(curves.one_vs_rest_areas(predictions, "score", "label", classes, ["round"]), ["round"]).collect()}
    assert macro[1] == pytest.approx(sum(got[1, c][0] for c in classes) / 3)


def test_report_compares_scores_in_their_own_type(spark):
    """Scores that are one double but two whole numbers."""
    big = 2**60
    df = spark.createDataFrame([(1.0, 1.0, big + 1), (0.0, 0.0, big)], "label double, prediction double, score bigint")
    found = {r.metric: r.value for r in evaluation_report(df, score="score", positive=1.0).where("label is null").collect()}
    assert found["roc_auc"] == 1.0


def test_groups_without_predictions_are_listed(spark, predictions):
    domain = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "label double")
    groups = spark.createDataFrame([(0,), (1,), (2,)], "round int")
    totals = cm.class_totals(cm.confusion(predictions, ["round"]), ["round"], domain, groups)
    assert rows(totals.where("round = 2")) == [(2, c, 0, 0, 0, 0) for c in (0.0, 1.0, 2.0)]
    assert rows(totals.where("round < 2")) == rows(cm.class_totals(cm.confusion(predictions, ["round"]), ["round"], domain))


def test_reversing_scores_mirrors_the_area(spark):
    df = spark.range(100).selectExpr("cast(id % 4 = 0 as int) label", "cast(id * 17 % 101 as double) s")
    up = curves.binary_areas(df, "s").first().roc_auc
    down = curves.binary_areas(df.withColumn("s", -F.col("s")), "s").first().roc_auc
    assert up + down == pytest.approx(1.0)


def test_all_scores_tied_and_one_class_only(spark):
    tied = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 1.0)], "label int, s double")
    areas = curves.binary_areas(tied, "s").first()
    assert areas.roc_auc == 0.5 and areas.pr_auc == pytest.approx(2 / 3)
    alone = curves.binary_areas(tied.filter("label = 1"), "s").first()
    assert alone.roc_auc is None and alone.pr_auc == 1.0
    none = curves.binary_areas(tied.filter("label = 0"), "s").first()
    assert none.roc_auc is None and none.pr_auc is None


def test_rows_without_a_score_do_not_count(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9), (1, None), (0, float("nan"))], "label int, s double")
    areas = curves.binary_areas(df, "s").first()
    assert (areas.positives, areas.negatives, areas.roc_auc) == (1, 1, 1.0)


def test_one_vs_rest_areas(predictions):
    got = {r.label: r.roc_auc for r in curves.one_vs_rest_areas(predictions, "score", "label", [0.0, 1.0, 2.0]).collect()}
    for c in (0.0, 1.0, 2.0):
        assert got[c] == pytest.approx(curves.binary_areas(predictions, "score", "label", c).first().roc_auc)
    own = predictions.withColumn("p", F.array("score", -F.col("score"), F.lit(1.0)))
    areas = curves.class_score_areas(own, "p", "label", [0.0, 1.0, 2.0])
    by_class = {r.label: r.roc_auc for r in areas.collect()}
    assert by_class[0.0] == pytest.approx(got[0.0]) and by_class[2.0] == 0.5
    assert by_class[1.0] == pytest.approx(1 - got[1.0])
    assert curves.macro_areas(areas).first().roc_auc == pytest.approx(sum(by_class.values()) / 3)


def test_report_holds_all_metrics(spark, predictions, tmp_path):
    report = evaluation_report(predictions, ["round"], score="score", positive=1.0)
    found = {(r.round, r.label, r.metric): r.value for r in report.collect()}
    assert len(found) == 2 * (3 * 4 + 12 + 2)
    one = predictions.filter("round = 1")
    assert found[(1, None, "roc_auc")] == pytest.approx(curves.binary_areas(one, "score", "label", 1.0).first().roc_auc)
    totals = cm.class_totals(cm.confusion(one))
    assert found[(1, None, "accuracy")] == pytest.approx(cm.overall_metrics(totals).first().accuracy)
    with pytest.raises(ValueError, match="positive class"):
        evaluation_report(predictions, score="score")
    path = str(tmp_path / "reports")
    write_report(report, path, "first")
    write_report(report, path, "second")
    write_report(report, path, "first")
    assert rows(spark.read.parquet(path).groupBy("experiment").count()) == [("first", 52), ("second", 52)]
