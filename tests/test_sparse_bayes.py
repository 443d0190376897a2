import hashlib
import time

import pytest
from comparing import rows
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rarelabel.catalog import bayes_queries
from rarelabel.functions.features import Features
from rarelabel.operators import naive_bayes, sparse_bayes
from rarelabel.plans import learners

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])


@pytest.fixture(scope="module")
def table(spark):
    data = []
    for i in range(90):
        x = [float((i * 7 + k * k) % 4) if (i + k) % 3 else 0.0 for k in range(6)]
        kept = [k for k, v in enumerate(x) if v]
        data.append((i, float(i % 3), Vectors.dense(x) if i % 2 else Vectors.sparse(6, kept, [x[k] for k in kept])))
    data.append((90, 0.0, Vectors.sparse(6, [], [])))
    return spark.createDataFrame(data, SCHEMA).cache()


def test_equals_the_library_and_the_narrow_form(table):
    model = sparse_bayes.fit(table, "features", 6)
    theirs = learners.naive_bayes().fit(table)
    theta = theirs.theta.toArray()
    pi = {r.label: r.pi for r in model.classes.collect()}
    assert [pi[float(c)] for c in range(3)] == pytest.approx(theirs.pi.toArray().tolist())
    for r in model.weights.collect():
        assert r.theta == pytest.approx(theta[int(r.label), r.pos])
    guessed = sparse_bayes.predict(sparse_bayes.scores(table, model, "features", ["id"]), ["id"])
    assert rows(guessed) == rows(theirs.transform(table), "id", "prediction")
    narrow = naive_bayes.score(table, naive_bayes.fit(table, Features.of_vector("features", 6)), Features.of_vector("features", 6), [0.0, 1.0, 2.0], keep=["id"])
    assert rows(narrow) == rows(guessed)


def test_groups_have_models_of_their_own(table):
    grouped = table.withColumn("half", (F.col("id") % 2).cast("int"))
    model = sparse_bayes.fit(grouped, "features", 6, by=["half"])
    guessed = sparse_bayes.predict(sparse_bayes.scores(grouped, model, "features", ["id"]), ["half", "id"])
    for h in (0, 1):
        part = grouped.where(F.col("half") == h)
        alone = sparse_bayes.predict(sparse_bayes.scores(part, sparse_bayes.fit(part, "features", 6), "features", ["id"]), ["id"])
        assert rows(guessed.where(F.col("half") == h), "id", "prediction") == rows(alone)


def test_the_plan_does_not_grow_with_the_width(spark):
    i = F.col("id")
    made = spark.range(1000).select("id", (i % 2).cast("double").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.struct(F.pmod(F.xxhash64(i, k), F.lit(100_000)).cast("int").alias("pos"), F.lit(1.0).alias("value"))).alias("features"))
    plans = []
    for width in (1_000, 100_000):
        start = time.monotonic()
        model = sparse_bayes.fit(made, "features", width)
        found = sparse_bayes.predict(sparse_bayes.scores(made, model, "features", ["id"]), ["id"])
        assert found.count() == 1000 and time.monotonic() - start < 60
        plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert abs(len(plans[0]) - len(plans[1])) < 100
    # only the few classes meet every row; positions are joined by their value
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in joins and "pos" in joins


def test_a_hot_position_is_dealt_in_parts(spark):
    i = F.col("id")
    made = spark.range(600).select("id", (i % 2).cast("double").alias("label"), F.array(F.struct(F.lit(5).alias("pos"), (1 + i % 2).cast("double").alias("value")), F.struct((i % 50 + 10).cast("int").alias("pos"), F.lit(1.0).alias("value"))).alias("features"))
    model = sparse_bayes.fit(made, "features", 100)
    one, many = (rows(sparse_bayes.scores(made, model, "features", ["id"], salts)) for salts in (1, 16))
    assert [r[:2] for r in one] == [r[:2] for r in many] and [r[2] for r in one] == pytest.approx([r[2] for r in many])


@pytest.mark.parametrize("features", ["cast(null as array<struct<pos:int,value:double>>)", "array(struct(1 as pos, -1.0D as value))", "array(struct(1 as pos, cast(null as double) as value))", "array(struct(1 as pos, double('NaN') as value))"])
def test_bad_features_are_errors_in_fit_and_score(spark, features):
    good = spark.range(4).selectExpr("id", "double(id % 2) AS label", "array(struct(1 as pos, 1.0D as value)) AS features")
    bad = spark.range(2).selectExpr("id", "double(id % 2) AS label", f"{features} AS features")
    with pytest.raises(Exception, match="null|not negative"):
        sparse_bayes.fit(bad, "features", 3)
    with pytest.raises(Exception, match="null|not negative"):
        sparse_bayes.scores(bad, sparse_bayes.fit(good, "features", 3), "features", ["id"]).collect()


def test_null_labels_are_errors(spark):
    df = spark.range(3).selectExpr("id", "cast(null as double) AS label", "array(struct(1 as pos, 1.0D as value)) AS features")
    with pytest.raises(Exception, match="null labels"):
        sparse_bayes.fit(df, "features", 3)


def test_weights_that_fit_are_broadcast_and_others_joined_by_shuffle(table):
    model = sparse_bayes.fit(table, "features", 6)
    near, far = (sparse_bayes.scores(table, model, "features", ["id"], broadcast_weights=n) for n in (1_000, 0))
    a, b = rows(near), rows(far)
    assert [r[:2] for r in a] == [r[:2] for r in b] and [r[2] for r in a] == pytest.approx([r[2] for r in b])
    assert ["_salt" in df._jdf.queryExecution().optimizedPlan().toString() for df in (near, far)] == [False, True]


def test_words_of_rows_that_share_a_document(spark, tmp_path):
    """One row for each id and language; only A-Z are lowered, and no word is lost."""
    data = [(1, "en", "The cat, the DOG"), (2, "en", None), (2, "de", "Äpfel\u212a x"), (3, "en", "a b"), (3, "en", "b c"), (3, "en", "b"), (4, "en", ""), (4, "en", "12")]
    spark.createDataFrame(data, "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:15], 16) % bayes_queries.WORD_WIDTH
    want = {(1, "en"): {"the": 2, "cat": 1, "dog": 1}, (2, "en"): {}, (2, "de"): {"pfel": 1, "x": 1}, (3, "en"): {"a": 1, "b": 3, "c": 1}, (4, "en"): {}}
    found = bayes_queries._word_entries(spark, str(tmp_path)).collect()
    assert len(found) == len(want)
    assert {(r.doc_id, r.lang): {e.pos: e.value for e in r.words} for r in found} == {k: {place(w): n for w, n in v.items()} for k, v in want.items()}
