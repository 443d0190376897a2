import pytest
from comparing import rows
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rarelabel.sources import variants


@pytest.fixture
def vectors(spark):
    def make(n, scale):
        i = F.col("id")
        return spark.range(n).select((i % 2).cast("double").alias("label"), array_to_vector(F.array((i * scale).cast("double"), F.lit(0.0), F.lit(0.0))).alias("features"))

    return make


def shown(df):
    return rows(df.select("label", vector_to_array("features").alias("x")))


def test_published_rows_are_read_back_with_their_width(spark, vectors, tmp_path):
    entry = variants.publish(vectors(4, 2), 3, str(tmp_path), "t", "chisq", 3)
    assert entry["rows"] == 4 and variants.current(spark, str(tmp_path), "t", "chisq", 3) == entry
    assert shown(variants.read_variant(spark, str(tmp_path), "t", "chisq", 3)) == [(0.0, [0.0, 0.0, 0.0]), (0.0, [4.0, 0.0, 0.0]), (1.0, [2.0, 0.0, 0.0]), (1.0, [6.0, 0.0, 0.0])]


def test_a_new_version_takes_the_place_of_the_old(spark, vectors, tmp_path):
    old = variants.publish(vectors(4, 1), 3, str(tmp_path), "t")
    new = variants.publish(vectors(6, 1), 3, str(tmp_path), "t")
    assert variants.versions(spark, str(tmp_path), "t") == [new["version"]] != [old["version"]]
    assert variants.read_variant(spark, str(tmp_path), "t").count() == 6


def test_a_run_that_fails_leaves_the_old_version(spark, vectors, tmp_path):
    old = variants.publish(vectors(4, 1), 3, str(tmp_path), "t")
    broken = vectors(6, 1).withColumn("label", F.when(F.col("label") == 1, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="broken"):
        variants.publish(broken, 3, str(tmp_path), "t")
    assert variants.current(spark, str(tmp_path), "t") == old and variants.read_variant(spark, str(tmp_path), "t").count() == 4
    variants.publish(vectors(5, 1), 3, str(tmp_path), "t")
    assert variants.read_variant(spark, str(tmp_path), "t").count() == 5


def test_variants_lie_beside_each_other_and_must_be_there(spark, vectors, tmp_path):
    variants.publish(vectors(4, 1), 3, str(tmp_path), "t", "pca", 3)
    variants.publish(vectors(2, 1), 3, str(tmp_path), "t", "oversampling")
    assert variants.read_variant(spark, str(tmp_path), "t", "pca", 3).count() == 4
    with pytest.raises(FileNotFoundError):
        variants.read_variant(spark, str(tmp_path), "t", "undersampling")
