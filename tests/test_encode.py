import pytest
from comparing import rows
from pyspark.sql import functions as F

from rarelabel.functions.ranking import number_in_order
from rarelabel.operators import counts, encode


@pytest.fixture
def words(spark):
    return spark.createDataFrame(
        [(1, "b", True), (2, "a", True), (3, "c", False), (4, "c", True), (5, None, None)],
        "id int, w string, f boolean",
    )


def test_index_by_frequency_with_ties_by_value(words):
    found = encode.fit_vocabulary(words, ["w", "f"])
    assert rows(found.values("w")) == [("a", 1, 1), ("b", 1, 2), ("c", 2, 0)]
    assert rows(found.values("f")) == [("false", 1, 1), ("true", 3, 0)]


def test_unseen_values(words):
    found = encode.fit_vocabulary(words, ["w"])
    assert rows(found.transform(words, "keep"), "id", "w")[-1] == (5, 3.0)
    assert found.transform(words, "skip").count() == 4
    with pytest.raises(Exception, match="null or unknown"):
        found.transform(words, "error").collect()
    with pytest.raises(ValueError):
        found.transform(words, "guess")


def test_indexed_columns_move_to_the_end(words):
    out = encode.fit_vocabulary(words, ["w"]).transform(words, "keep")
    assert out.columns == ["id", "f", "w"]


def test_large_vocabularies_take_the_parallel_path(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("v"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("string")).alias("w"),
    )
    small = encode.fit_vocabulary(df, ["v", "w"])
    large = encode.fit_vocabulary(df, ["v", "w"], single_task_values=3, broadcast_values=20)
    assert rows(small.table, "column", "value", "n", "idx") == rows(large.table, "column", "value", "n", "idx")
    a, b = small.transform(df, "keep"), large.transform(df, "keep")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_long_values_shrink_the_broadcast(spark):
    df = spark.range(40).select(F.repeat((F.col("id") % 10).cast("string"), 1000).alias("v"))
    found = encode.fit_vocabulary(df, ["v"], broadcast_bytes=5000)
    assert found.heads["v"] == 4
    whole = encode.fit_vocabulary(df, ["v"])
    assert rows(found.transform(df)) == rows(whole.transform(df))


def test_column_of_nulls_has_no_values(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v string")
    found = encode.fit_vocabulary(df, ["v"])
    assert found.sizes == {"v": 0} and rows(found.transform(df, "keep")) == [(1, 0.0), (2, 0.0)]


def test_number_in_order_matches_a_single_sort(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    placed = rows(number_in_order(df, [F.desc("k")], "i"), "i", "k")
    assert [i for i, _ in placed] == list(range(1000))
    assert [k for _, k in placed] == sorted((k for _, k in placed), reverse=True)


def test_missing_category_and_combined_flags(spark):
    df = spark.createDataFrame([("x", 0, 1), ("?", 0, 0), (None, None, 1)], "v string, a int, b int")
    out = df.select(encode.missing_as_category(F.col("v"), ["?"]).alias("v"), encode.combine_flags("a", "b").alias("c"))
    assert rows(out) == [("__missing__", 0), ("__missing__", 1), ("x", 1)]


def test_assemble_and_null_policy(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 1.0)], "id int, a double, label double")
    with pytest.raises(Exception):
        encode.assemble(df, ["a"]).collect()
    assert encode.assemble(df, ["a"], keep=["id"], on_null="skip").count() == 1


def test_categories_are_positions_with_few_values(spark):
    df = spark.range(100).selectExpr("cast(id % 3 as double) a", "cast(id as double) b", "0 label")
    vectors = encode.assemble(df, ["a", "b"])
    assert rows(encode.category_table(vectors, encode.fit_categories(vectors))) == [(0, 0.0, 0), (0, 1.0, 1), (0, 2.0, 2)]


def test_class_counts_are_checked(spark):
    df = spark.createDataFrame([(1,), (1,), (0,)], "label int")
    assert counts.class_counts(df) == {0: 1, 1: 2}
    assert rows(counts.class_extremes(df)) == [(2, 1, 2, 3)]
    assert rows(counts.label_domain(df)) == [(0,), (1,)]
    with pytest.raises(ValueError, match="more than 1"):
        counts.class_counts(df, limit=1)
    with pytest.raises(ValueError, match="null"):
        counts.class_counts(df.unionByName(spark.createDataFrame([(None,)], "label int")))


def test_input_is_read_once_however_many_columns_are_large(spark, tmp_path):
    names = [f"c{k}" for k in range(6)]
    made = spark.range(400).select("id", *[F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(((F.col("id") * (k + 2)) % 97).cast("string")).alias(n) for k, n in enumerate(names)])
    made.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    for large in (1, 3, 6):
        found = encode.fit_vocabulary(df.select("id", *names[:large]), names[:large], broadcast_values=5)
        assert all(found.sizes[n] > found.heads[n] for n in names[:large])
        out = found.transform(df, "keep")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [id") == 1
        small = encode.fit_vocabulary(df.select("id", *names[:large]), names[:large]).transform(df, "keep")
        assert rows(out) == rows(small.select(*out.columns))


def test_all_columns_share_one_byte_budget(spark):
    df = spark.range(3000).select(*[F.concat(F.lit("x" * 36), (F.col("id") % m).cast("string")).alias(n) for n, m in (("a", 10), ("b", 1000), ("c", 3000))])
    found = encode.fit_vocabulary(df, ["a", "b", "c"], broadcast_bytes=60_000)
    assert found.heads["a"] == 10 and 0 < found.heads["c"] <= found.heads["b"] < 1000
    assert sum(found.heads[c] * (64 + 36 + len(str(n - 1))) for c, n in (("a", 10), ("b", 1000), ("c", 3000))) <= 60_000


def test_rows_of_hot_values_are_spread(spark, monkeypatch):
    """Rows that the broadcast part settles do not meet in one partition."""
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.col("id").cast("string")).alias("v"))
    found = encode.fit_vocabulary(df, ["v"], broadcast_values=1)
    monkeypatch.setattr(encode, "_PARTS", 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = found.transform(df, "keep").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) == 8 and max(r["count"] for r in held) < 3 * 4000 / 8
