import pytest
from comparing import rows
from pyspark.sql import functions as F

from rarelabel.operators import impute


@pytest.fixture
def table(spark):
    nan = float("nan")
    data = [(1.0, 5, "x", None), (3.0, None, "y", None), (None, 7, "x", None), (nan, 7, None, None), (-9.0, 9, "y", None), (8.0, -9, "z", None)]
    return spark.createDataFrame(data, "a double, b int, c string, d double")


def test_sentinels_become_null(table):
    clean = impute.without_sentinels(table, {"a": [-9.0], "b": [-9], "c": []})
    assert clean.where("a = -9 or b = -9").count() == 0 and clean.where("a is null").count() == 2


def test_fillings_and_ties(spark, table):
    clean = impute.without_sentinels(table, {"a": [-9.0], "b": [-9]})
    found = impute.fit_fillings(clean, {"a": "mean", "b": "median", "c": "mode", "d": "mean"})
    assert rows(found.table) == [("a", "mean", "4.0", 3, 3), ("b", "median", "7.0", 4, 2), ("c", "mode", "x", 5, 1), ("d", "mean", None, 0, 6)]
    filled = found.transform(clean, flag="_was_missing")
    assert sorted(r.a for r in filled.collect()) == [1.0, 3.0, 4.0, 4.0, 4.0, 8.0]
    assert filled.where("c = 'x'").count() == 3 and filled.where("d is not null").count() == 0
    assert filled.agg(F.sum("a_was_missing")).first()[0] == 3.0 and filled.agg(F.sum("b_was_missing")).first()[0] == 2.0
    assert filled.schema["c"].dataType.simpleString() == "string"


def test_other_sides_are_filled_with_what_the_training_side_gave(spark):
    train, test = spark.createDataFrame([(1.0,), (2.0,)], "a double"), spark.createDataFrame([(None,), (100.0,)], "a double")
    assert rows(impute.fit_fillings(train, {"a": "mean"}).transform(test)) == [(1.5,), (100.0,)]


def test_median_of_many_rows_and_mode_of_a_hot_value(spark):
    df = spark.range(100_001).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") % 3 == 0, 42).otherwise(F.col("id")).alias("b"))
    found = {r["column"]: float(r["value"]) for r in impute.fit_fillings(df, {"a": "median", "b": "mode"}).table.collect()}
    assert abs(found["a"] - 50_000) <= 2 and found["b"] == 42


def test_unknown_policies_and_empty_tables(spark, table):
    with pytest.raises(ValueError, match="policies"):
        impute.fit_fillings(table, {"a": "guess"})
    with pytest.raises(ValueError, match="none given"):
        impute.fit_fillings(table, {})
    assert rows(impute.fit_fillings(table.where("false"), {"a": "mean"}).table, "value", "present") == [(None, 0)]
