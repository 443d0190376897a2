"""Inputs that must not change answers or lose rows without a word."""

import math

import pytest
from pyspark.sql import functions as F

from rarelabel.functions.probability import _large_shape_tail, chi_square_tail
from rarelabel.operators.confusion import class_totals
from rarelabel.operators.curves import binary_areas, curve_areas, score_counts
from rarelabel.operators.resample import undersample
from rarelabel.operators.split import with_fold, with_side
from rarelabel.plans.importer import import_text
from rarelabel.sources.schemas import TableSchema
from rarelabel.sources.text import read_table, write_table


def test_large_shape_joins_the_series():
    for degrees in (2_000.0, 20_000.0, 39_999.0):
        for z in (-5.0, -1.0, -1e-3, 0.0, 1e-3, 1.0, 5.0):
            x = degrees + z * math.sqrt(2 * degrees)
            assert _large_shape_tail(degrees / 2, x / 2) == pytest.approx(chi_square_tail(x, degrees), rel=1e-6, abs=1e-11)


@pytest.mark.parametrize("degrees", [1e5, 2e8, 2e9, 1e10])
def test_p_values_at_many_degrees(degrees):
    spread = math.sqrt(2 * degrees)
    assert chi_square_tail(degrees, degrees) == pytest.approx(0.5, abs=2e-3)
    for z in (-2.0, -1.0, 1.0, 2.0):
        assert chi_square_tail(degrees + z * spread, degrees) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=2e-3)


def areas(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"score {kind}, label int")
    return binary_areas(df, "score").first()


def test_rows_without_score_are_told(spark):
    for score in (None, float("nan")):
        rows = spark.createDataFrame([(0.9, 1), (0.1, 0), (score, 0)], "score double, label int")
        with pytest.warns(UserWarning, match="1 rows have no score"):
            assert binary_areas(rows, "score").first()["negatives"] == 1
        with pytest.raises(ValueError, match="1 rows have no score"):
            curve_areas(score_counts(rows, "score", F.col("label") == 1), unscored="error")


def test_wide_integer_scores_keep_their_order(spark):
    rows = [(10**17 + i % 8, int(i % 8 >= 4 or i == 1)) for i in range(16)]
    want = sum((p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b) / (sum(a for _, a in rows) * sum(1 - a for _, a in rows))
    assert areas(spark, rows, "bigint")["roc_auc"] == pytest.approx(want)


def test_repeated_keys_are_errors_in_undersampling(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.when(F.col("id") < 80, 0).otherwise(1).alias("label"))
    with pytest.raises(Exception, match="not unique"):
        undersample(df, "label", "k", seed=7).collect()


def test_null_keys_are_errors_in_splits(spark):
    df = spark.createDataFrame([(None,), (1,)], "id bigint")
    for marked in (with_side(df, "id", 7), with_fold(df, "id", 3, 7)):
        with pytest.raises(Exception, match="is null"):
            marked.collect()


def test_domain_without_predictions(spark):
    counts = spark.createDataFrame([], "label double, prediction double, n bigint")
    domain = spark.createDataFrame([(0.0,), (1.0,)], "label double")
    assert sorted(tuple(r) for r in class_totals(counts, domain=domain).collect()) == [(0.0, 0, 0, 0, 0), (1.0, 0, 0, 0, 0)]


SCHEMA = TableSchema.parse("t", "b:s a")


def test_written_text_keeps_nulls_and_empty_strings(spark, tmp_path):
    rows = [("x", 1.0), (None, 2.0), ("", None), ("y z", 4.0)]
    write_table(spark.createDataFrame(rows, "b string, a double"), str(tmp_path / "t"), blanks="underscore")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert lines == sorted(["x 1.0", "NA 2.0", "'' NA", "y_z 4.0"])
    back = read_table(spark, str(tmp_path / "t"), SCHEMA, missing=["NA"], empty="''")
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, [("x", 1.0), (None, 2.0), ("", None), ("y_z", 4.0)]))
    with pytest.raises(Exception, match="equals the token"):
        write_table(spark.createDataFrame([("NA",)], "b string"), str(tmp_path / "u"))


def test_values_with_blanks_are_an_error_unless_they_may_merge(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("a_b",)], "b string")
    with pytest.raises(Exception, match="holds a blank"):
        write_table(df, str(tmp_path / "t"))
    write_table(df, str(tmp_path / "t"), blanks="underscore")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a_b", "a_b"]
    with pytest.raises(ValueError, match="blanks"):
        write_table(df, str(tmp_path / "t"), blanks="merge")


def test_lines_that_do_not_fit(spark, tmp_path):
    schema = TableSchema.parse("t", "a kind:s label")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0").write_text("1 x 0\n2 y\nz y 1\n3 y 1\n")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    with pytest.raises(ValueError, match="too_few_fields"):
        import_text(spark, source, schema, out)
    done = import_text(spark, source, schema, out, on_bad="divert")
    assert done.rejected == {"too_few_fields": 1, "bad_number": 1}
    assert spark.read.parquet(f"{out}.rejected").count() == 2
