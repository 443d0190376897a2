import duckdb
import pytest
from comparing import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rarelabel.functions.hashing import HASH_SPACE, below, uniform_hash
from rarelabel.operators import resample, split

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def sizes(df):
    return dict(rows(df.groupBy("label").count()))


def rounds_formula(n, sizes_):
    m, low = max(sizes_), min(sizes_)
    t = m // low + 1
    return n + t * -(-(m - n) // t)


def test_hash_agrees_with_sql_and_is_uniform(spark):
    df = spark.range(2000).select("id", uniform_hash("id", seed=3).alias("h"))
    found = {r.id: r.h for r in df.collect()}
    sql = "SELECT ('0x' || substr(md5(concat_ws(':', i, '3')), 1, 15))::bigint FROM range(2000) t(i)"
    assert list(found.values()) == [r[0] for r in duckdb.connect().execute(sql).fetchall()]
    assert all(0 <= h < HASH_SPACE for h in found.values())
    assert abs(sum(h < below(0.3) for h in found.values()) / 2000 - 0.3) < 0.05
    with pytest.raises(ValueError):
        below(1.5)


def test_split_is_a_partition_and_ignores_layout(spark):
    df = spark.range(1000)
    parts = split.split_rows(df, "id", 5, (0.5, 0.3, 0.2))
    ids = [set(r.id for r in p.collect()) for p in parts]
    assert set.union(*ids) == set(range(1000)) and sum(map(len, ids)) == 1000
    again = [set(r.id for r in p.collect()) for p in split.split_rows(df.repartition(7), "id", 5, (5, 3, 2))]
    assert ids == again
    assert all(abs(len(i) / 1000 - w) < 0.06 for i, w in zip(ids, (0.5, 0.3, 0.2)))


def test_sides_match_the_two_way_split(spark):
    df = spark.range(500)
    train, test = split.split_rows(df, "id", 9)
    marked = split.with_side(df, "id", 9)
    assert rows(train) == rows(marked.filter("side = 'train'"), "id")
    assert rows(test) == rows(marked.filter("side = 'test'"), "id")


def test_folds_cover_all_rows(spark):
    folded = split.with_fold(spark.range(1000), "id", 10, 1)
    counts = dict(rows(folded.groupBy("fold").count()))
    assert set(counts) == set(range(10)) and sum(counts.values()) == 1000 and min(counts.values()) > 60


def test_holdout_plan_agrees_with_the_expression(spark):
    plan = split.holdout_plan(spark, 20, 64, 0.25, 2)
    listed = {(r.cell, q) for r in plan.collect() for q in r.test}
    pairs = spark.range(64).selectExpr("cast(id as int) cell", "explode(sequence(0, 19)) round")
    direct = {(r.cell, r.round) for r in pairs.filter(split.cell_is_test("cell", "round", 0.25, 2)).collect()}
    assert listed == direct
    assert all(len(r.test) + len(r.train) == 20 for r in plan.collect())


def test_oversampling_reproduces_the_known_class_sizes(classes):
    out = resample.oversample(classes(125, 43, 29, 26, 9), "label", "id", 1)
    assert sizes(out) == {0: 125, 1: 127, 2: 127, 3: 138, 4: 135}


@FEW
@given(st.lists(st.integers(1, 60), min_size=2, max_size=4))
def test_oversampling_formula(classes, spark, n):
    df = classes(*n)
    out = resample.oversample(df, "label", "id", 1)
    assert sizes(out) == {i: rounds_formula(v, n) for i, v in enumerate(n)}
    assert out.select("id").distinct().count() == sum(n)
    assert out.exceptAll(df).count() == out.count() - sum(n)


def test_exact_mode_reaches_the_largest_class(classes):
    assert set(sizes(resample.oversample(classes(50, 7, 21), "label", "id", 1, "exact")).values()) == {50}
    with pytest.raises(ValueError):
        resample.oversample_plan(classes(2, 1), mode="other")


def test_balanced_classes_are_left_alone(classes):
    df = classes(5, 5)
    assert rows(resample.oversample(df, "label", "id", 1)) == rows(df)


def test_buckets_and_salts_do_not_change_the_draw(classes):
    df = classes(200, 3, 40)
    plain = rows(resample.oversample(df, "label", "id", 8))
    cut = rows(resample.oversample(df.repartition(5), "label", "id", 8, rows_per_bucket=4, per_copy_task=2))
    assert plain == cut
    whole = rows(resample.undersample(df, "label", "id", 8, target=3))
    cut = rows(resample.undersample(df.repartition(3), "label", "id", 8, target=3, rows_per_bucket=2))
    assert whole == cut


def test_draws_in_many_chunks(classes, monkeypatch):
    df = classes(90, 2)
    before = rows(resample.oversample(df, "label", "id", 8))
    monkeypatch.setattr(resample, "DRAWS_PER_CHUNK", 7)
    assert rows(resample.oversample(df, "label", "id", 8)) == before


def test_numbers_follow_hash_order(classes):
    df = classes(100, 30)
    for bits in (0, 3):
        numbered = resample.number_within_class(df, "label", "id", 4, bits)
        got = rows(numbered.withColumn("h", uniform_hash("id", seed=4)), "label", "_idx", "h")
        for c, n in ((0, 100), (1, 30)):
            mine = [(i, h) for label, i, h in got if label == c]
            assert [i for i, _ in mine] == list(range(n))
            assert [h for _, h in mine] == sorted(h for _, h in mine)


def test_undersampling_sizes(classes):
    df = classes(80, 12, 33)
    kept = resample.undersample(df, "label", "id", 1)
    assert set(sizes(kept).values()) == {12} and kept.distinct().count() == 36
    drawn = resample.undersample(df, "label", "id", 1, replace=True)
    assert set(sizes(drawn).values()) == {12} and drawn.distinct().count() < 36
    assert set(sizes(resample.undersample(df, "label", "id", 1, target=0.5)).values()) == {6}
    assert set(sizes(resample.undersample(df, "label", "id", 1, target=20, replace=True)).values()) == {20}
    with pytest.raises(ValueError, match="fewer than"):
        resample.undersample(df, "label", "id", 1, target=20)


def test_single_row_class_can_be_drawn_many_times(classes):
    assert sizes(resample.oversample(classes(30, 1), "label", "id", 1, "exact")) == {0: 30, 1: 30}


def test_stratified_sample_takes_the_ceiling(classes):
    df = classes(10, 7)
    assert sizes(resample.stratified_sample(df, "label", "id", {0: 0.25, 1: 2.0}, 1)) == {0: 3, 1: 14}
    assert sizes(resample.stratified_sample(df, "label", "id", {0: 0.25}, 1, replace=False)) == {0: 3}
    with pytest.raises(ValueError, match="no rows"):
        resample.stratified_sample(df, "label", "id", {5: 0.5}, 1)


def test_repeated_keys_are_refused(classes):
    df = classes(9, 3)
    with pytest.raises(Exception, match="not unique"):
        resample.oversample(df.union(df), "label", "id", 1).collect()


def test_null_keys_are_refused(classes):
    df = classes(9, 3).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    with pytest.raises(Exception, match="is null"):
        resample.undersample(df, "label", "id", 1, replace=True).collect()


def test_round_rows_list_every_round(spark):
    plan = split.holdout_plan(spark, 5, 8, 0.3, 2)
    cells = spark.range(8).selectExpr("cast(id as int) cell")
    got = {(r.cell, r.round): r.held_out for r in split.round_rows(cells, plan).collect()}
    want = {(r.cell, q): True for r in plan.collect() for q in r.test}
    assert len(got) == 40 and {k for k, v in got.items() if v} == set(want)


def test_composite_keys_and_extra_columns(classes):
    df = classes(40, 6).select("label", (F.col("id") % 5).alias("a"), (F.col("id") / 5).cast("int").alias("b"), F.col("id").alias("x"))
    out = resample.undersample(df, "label", ["a", "b"], 1)
    assert out.columns == df.columns and sizes(out) == {0: 6, 1: 6}
    assert sizes(resample.oversample(df, "label", ["a", "b"], 1, "exact")) == {0: 40, 1: 40}
